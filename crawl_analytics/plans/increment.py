"""Incremental enrichment: a manifest of the input files says which experiments have to be processed again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SYSTEM_EXPERIMENT
from ..operators.enrich import dedup_workers
from ..operators.rules import parse_rules
from ..session import new_run_dir
from ..sources.lake import COMMITS, commit_log, copy_metadata, document_entries, empty, experiments_with_rows, frames_of, materialize, read_metadata, read_workers, write_table
from ..sources.lists import chosen_lists, read_filter_lists
from .enrichment import KINDS, enrich

MANIFEST = "_manifest"
ENTRY = "path string, length bigint, modified timestamp"
RULES = "rules"  # the entry that stands for the filter lists


def input_files(spark: SparkSession, root: str, committed: bool = False) -> DataFrame:
    """(path, length, modified) of all files of the lake; a listing, no rows are opened. A written document is an entry of its own, told by its write."""
    at = f"{root}/batch=*" if committed else root
    shapes = [f"{at}/experiment=*/data_type=*", f"{root}/experiment=*/document=metadata", f"{root}/experiment=*/metadata.json"]
    found = frames_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load, shapes)
    written = document_entries(spark, root).select(F.concat("path", F.col("write").cast("string")).alias("path"), "length", F.lit(None).cast("timestamp").alias("modified"))
    files = reduce(DataFrame.unionByName, [written, *[f.select("path", "length", F.col("modificationTime").alias("modified")) for f in found]])
    if committed:
        batch = F.regexp_extract("path", "/batch=([0-9]+)/", 1).try_cast("bigint")
        known = files.withColumn("batch", batch).join(F.broadcast(commit_log(spark, root)), "batch", "left_semi").drop("batch")
        files = known.unionByName(files.where(batch.isNull()))
    return files.where(~F.contains("path", F.lit(f"/{COMMITS}/")))


def _rules_entry(rules: DataFrame) -> DataFrame:
    """The lists as one entry: another rule, another length."""
    total = F.coalesce(F.sum(F.pmod("rule_id", F.lit(1 << 40))), F.lit(0)).cast("bigint")
    return rules.agg(total.alias("length")).select(F.lit(RULES).alias("path"), "length", F.lit(None).cast("timestamp").alias("modified"))


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The files that the last finished run had seen."""
    runs = frames_of(spark.read.schema(ENTRY + ", run bigint").parquet, [f"{out}/{MANIFEST}"])
    if not runs:
        return empty(spark, ENTRY)
    last = runs[0].agg(F.max("run")).first()[0]
    return runs[0].where(F.col("run") == F.lit(last)).drop("run")


def changed_experiments(now: DataFrame, before: DataFrame) -> list[str] | None:
    """Experiments with files that came, went or changed; ``None`` for all of them, if the rules did."""
    same = ["path", "length", "modified"]
    on = lambda x, y: [x[c].eqNullSafe(y[c]) for c in same]
    came, went = now.join(before, on(now, before), "left_anti"), before.join(now, on(before, now), "left_anti")
    each = came.select("path").union(went.select("path"))
    name = F.when(F.col("path") == RULES, F.lit(RULES)).otherwise(F.regexp_extract("path", "/experiment=([^/]+)/", 1))
    # experiments are started by hand, so their names fit the driver; the files stay in Spark
    found = sorted(r["name"] for r in each.select(F.concat(F.when(F.col("path") == RULES, F.lit("/")).otherwise(F.lit("")), name).alias("name")).distinct().collect())
    return None if f"/{RULES}" in found else found


def enrich_increment(spark: SparkSession, root: str, out: str, filter_lists: str | None = None, committed: bool = False) -> list[str]:
    """Bring the enriched tables up to date with the lake; the experiments that were processed.

    The lake's listing is compared with the manifest of the last run. Experiments with new, changed or missing files are
    processed again as a whole, for a new file may change which session of a seed is kept; their partitions are replaced and
    no file of the others is opened. New workers belong to every experiment: their table is written anew. Other filter
    lists mean all experiments. The manifest is written last, so a run that breaks is done again, and files
    that arrive meanwhile are new to the next run.
    """
    rules = materialize(parse_rules(read_filter_lists(spark, chosen_lists(filter_lists))), new_run_dir(spark, "rules"))
    listed = materialize(input_files(spark, root, committed).unionByName(_rules_entry(rules)), new_run_dir(spark, "listing"))
    changed = changed_experiments(listed, read_manifest(spark, out))
    present = experiments_with_rows(spark, root, list(KINDS), committed=committed)
    documents = read_metadata(spark, root).select(F.col("exp_id").alias("id"))
    known = present.join(documents, "id", "left_semi")
    wanted = known if changed is None else known.where(F.col("id").isin(changed))
    names = sorted(r["id"] for r in wanted.collect())
    if names:
        enrich(spark, root, out, filter_lists, names, committed, rules=rules)
    if changed is None or changed:  # documents of experiments without rows, too
        copy_metadata(spark, root, out, changed)
    if changed is not None and SYSTEM_EXPERIMENT in changed:
        workers = dedup_workers(read_workers(spark, root, known))
        write_table(materialize(workers, new_run_dir(spark, "workers")), f"{out}/worker_metadata", ["experiment_id"])
    if changed is None or changed:
        runs = frames_of(spark.read.schema(ENTRY + ", run bigint").parquet, [f"{out}/{MANIFEST}"])
        last = (runs[0].agg(F.max("run")).first()[0] if runs else None) or 0
        listed.withColumn("run", F.lit(last + 1).cast("bigint")).write.mode("append").parquet(f"{out}/{MANIFEST}")
    return names
