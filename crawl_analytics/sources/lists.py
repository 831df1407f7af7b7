"""Side inputs: ranked site list, country catalogue, filter lists."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_FILTER_LISTS, EU_COUNTRY_CODES
from ..schemas import COUNTRIES, TRANCO
from .lake import empty


def read_tranco(spark: SparkSession, path: str) -> DataFrame:
    """Rank and domain from headerless CSV files of a folder."""
    return spark.read.schema(TRANCO).csv(path)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """The four catalogue columns in use, whatever else the CSV has."""
    names = [part.split(" ")[0] for part in COUNTRIES.split(", ")]
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*names)


def region_catalog(countries: DataFrame) -> DataFrame:
    """(tld_key, continent, subregion, is_eu), one row per top-level domain of a country."""
    keys = F.split(F.replace(F.col("tld"), F.lit("."), F.lit("")), ",")
    each = countries.select(F.explode(keys).alias("key"), "region", "subregion", "cca2")
    return each.select(
        F.lower("key").alias("tld_key"),
        F.col("region").alias("continent"),
        "subregion",
        F.col("cca2").isin(EU_COUNTRY_CODES).alias("is_eu"),
    )


def list_name(url: str) -> str:
    """Short name of a filter list: the file's stem."""
    base = url.rstrip("/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base else base


def chosen_lists(choice: str | None = None) -> list[str]:
    """The given comma-separated lists, or the default twelve."""
    if not choice:
        return list(DEFAULT_FILTER_LISTS)
    return [part.strip() for part in choice.split(",") if part.strip()]


def read_filter_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(list_ord, list_name, line) of all lists that can be read; trimmed, without blank lines.

    A list is opened while the plan is built; one that cannot be is skipped with a warning. If none of them can, that is an error:
    such a run would label nothing. Lists are files: the default ones have to be fetched first.
    """
    out = empty(spark, "list_ord int, list_name string, line string")
    # of two lists with one name the later takes the place of the earlier
    named = {list_name(path): path for path in paths}
    failed: list[str] = []
    for i, (name, path) in enumerate(named.items()):
        try:
            text = spark.read.text(path)
            text.head()  # some stores only fail when a file is opened
        except (PySparkException, Py4JError) as error:
            failed.append(path)
            warnings.warn(f"filter list {path} skipped: {str(error).splitlines()[0]}", stacklevel=2)
        else:
            lines = text.select(F.lit(i).alias("list_ord"), F.lit(name).alias("list_name"), F.trim("value").alias("line"))
            out = out.unionByName(lines.filter("line <> ''"))
    if failed and len(failed) == len(named):
        raise FileNotFoundError(f"no filter list can be read: {', '.join(failed)}")
    return out
