"""Seeds, crawl tasks and experiment rows."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BROWSERS, PARAM_DEFAULTS, SUBJECT_PREFIX
from ..functions.urls import normalize_url
from ..schemas import PARAMS

_KINDS = {
    "auto_accept_cookies": "boolean",
    "navigate_subpages": "boolean",
    "max_depth": "int",
    "dwell_time": "int",
    "scroll_amounts": "array<bigint>",
    "browser_type": "string",
    "headless": "boolean",
}


def top_seeds(tranco: DataFrame, n: int) -> DataFrame:
    """The first n sites by rank, with normalised URLs."""
    top = tranco.orderBy("tranco_rank", "domain").limit(n)
    return top.select("tranco_rank", "domain", normalize_url(F.col("domain")).alias("url"))


def _literal(name: str, value) -> Column:
    if name == "scroll_amounts":
        return F.array(*[F.lit(v) for v in value]).cast("array<bigint>")
    return F.lit(value).cast(_KINDS[name])


def validate_params(params: dict) -> dict:
    """Fill in defaults; unknown names, wrong types and unknown browsers are errors."""
    unknown = set(params) - set(PARAM_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    full = {**PARAM_DEFAULTS, **params}
    for name, default in PARAM_DEFAULTS.items():
        wanted = type(default)
        if type(full[name]) is not wanted:
            raise ValueError(f"{name} must be {wanted.__name__}")
    if full["browser_type"] not in BROWSERS:
        raise ValueError(f"browser_type must be one of {BROWSERS}")
    return full


def params_struct(source: Column) -> Column:
    """Params of a parsed document with defaults filled in."""
    return F.struct(
        *[F.coalesce(source[name], _literal(name, default)).alias(name) for name, default in PARAM_DEFAULTS.items()]
    ).cast(PARAMS)


def valid_browser(browser: Column) -> Column:
    return browser.isin(BROWSERS)


def routing_key(browser: Column, headless: Column, experiment: Column, prefix: str = SUBJECT_PREFIX) -> Column:
    """``prefix.browser.mode.experiment``."""
    mode = F.when(headless, F.lit("headless")).otherwise(F.lit("headed"))
    return F.concat_ws(".", F.lit(prefix), browser, mode, experiment)


def build_tasks(seeds: DataFrame, params: dict, experiment_id: str, prefix: str = SUBJECT_PREFIX) -> DataFrame:
    """One task per seed URL with every parameter and its routing key."""
    full = validate_params(params)
    tasks = seeds.select("url", F.lit(experiment_id).alias("experiment_id"), *[_literal(n, v).alias(n) for n, v in full.items()])
    return tasks.withColumn("subject", routing_key(F.col("browser_type"), F.col("headless"), F.col("experiment_id"), prefix))


def lane(tasks: DataFrame, browser: str, headless: bool) -> DataFrame:
    """Tasks one kind of worker takes."""
    return tasks.filter((F.col("browser_type") == browser) & (F.col("headless") == F.lit(headless)))


def new_experiment_id(name: str) -> str:
    """``name_`` and eight hexadecimal digits; the name must be alphanumeric."""
    if not name.isalnum():
        raise ValueError(f"invalid name {name!r}: letters and digits only")
    return f"{name}_{uuid.uuid4().hex[:8]}"


def build_experiment(seeds: DataFrame, params: dict, experiment_id: str, created: datetime) -> DataFrame:
    """The experiment's one-row document; no seeds is an error when the row is read."""
    full = validate_params(params)
    values = F.struct(*[_literal(n, v).alias(n) for n, v in full.items()])
    counted = seeds.agg(F.count(F.lit(1)).alias("total_urls"))
    checked = F.when(F.col("total_urls") > 0, F.col("total_urls")).otherwise(
        F.raise_error(F.lit("no URLs found, the list is empty")).cast("bigint")
    )
    return counted.select(
        F.lit(experiment_id).alias("id"), F.lit(created).alias("timestamp"), checked.alias("total_urls"), values.alias("params")
    )
