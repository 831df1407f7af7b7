"""Compaction of a lake of committed batches: many small flush files become few sorted ones, swapped by one entry of the log."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import open_writers
from ..sources.lake import COMMITS, UNREADABLE, commit_entries, commit_log, empty, frames_of, read_raw, read_unreadable, write_events
from .commits import abort, enter

COMPACTED = 1 << 40  # numbers of compacted batches begin here; a stream's own batches stay below
FILE_BYTES = 256 << 20


def batch_files(spark: SparkSession, root: str, log: DataFrame) -> DataFrame:
    """(batch, experiment, data_type, length) of the files of the batches in ``log``; a listing, nothing is opened."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    found = frames_of(reader.load, [f"{root}/batch=*"])
    if not found:
        return empty(spark, "batch bigint, experiment string, data_type string, length bigint")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)
    files = reduce(DataFrame.unionByName, found).select(part("batch").cast("bigint").alias("batch"), part("experiment"), part("data_type"), "length")
    return files.join(F.broadcast(log), "batch", "left_semi")


def _sorted(rows: DataFrame, files: int) -> DataFrame:
    """Rows in ``files`` ranges of experiment and time, sorted inside, so that row groups hold short spans of time."""
    order = [c for c in ("experiment_id", "timestamp", "request_id", "crawl_session_id", "event") if c in rows.columns]
    return rows.repartitionByRange(files, *order).sortWithinPartitions(*order)


def compact(spark: SparkSession, root: str, file_bytes: int = FILE_BYTES, again: bool = False) -> int | None:
    """Merge the committed batches of a stream into one batch of few files; its number, or None if there are fewer than two.

    The rows of each kind, as readers see them, are dealt to ranges of experiment and time, as many as
    the files' bytes fill files of the wished size; an experiment with most of the rows
    becomes many ranges. The new batch counts, and the old ones no longer do, once one entry ``replaces-<from>-<to>`` is in the log:
    a reader that lists the log sees either. A run that breaks before leaves files that nobody sees and the
    next run removes. Old files stay for readers that began earlier, until ``drop_uncommitted``; their own entries stay
    as well, so that the stream never writes these batches again. ``again`` merges the results of earlier compactions, instead of
    new batches. One compaction runs at a time; the stream may go on meanwhile.
    """
    compacted = F.col("batch") >= F.lit(COMPACTED)
    log = commit_log(spark, root).where(compacted if again else ~compacted)
    span = log.agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("low"), F.max("batch").alias("high")).first()
    if span["n"] < 2:
        return None
    # fixed from here on: batches that the stream commits meanwhile are above
    log = log.where(F.col("batch") <= F.lit(span["high"]))
    last = commit_entries(spark, root).agg(F.max("batch")).first()[0]
    number = max(last, COMPACTED) + 1
    abort(spark, root, number)
    sizes = batch_files(spark, root, log).groupBy("data_type").agg(F.sum("length").alias("length"))
    for row in sizes.orderBy("data_type").collect():  # one row per kind of event
        kind, files = row["data_type"], max(1, math.ceil(row["length"] / file_bytes))
        rows = read_unreadable(spark, root, log) if kind == UNREADABLE else read_raw(spark, root, kind, committed=log, system=True)
        with open_writers(spark, 0):  # sorted rows need no other sort and stay in order
            write_events(_sorted(rows, files), f"{root}/batch={number}", kind)
    enter(spark, root, number, f"replaces-{span['low']}-{span['high']}")
    return number
