"""Progress of experiments from queue depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SUBJECT_PREFIX


def remaining(depths: DataFrame | None, experiments: DataFrame, prefix: str = SUBJECT_PREFIX) -> DataFrame:
    """(id, remaining): pending tasks over ``prefix.*.*.id``, 0 without a subject, -1 when the queue is unknown."""
    ids = experiments.select("id")
    if depths is None:
        return ids.withColumn("remaining", F.lit(-1).cast("bigint"))
    shape = "^" + prefix.replace(".", r"\.") + r"\.[^.]+\.[^.]+\.([^.]+)$"
    pending = (
        depths.withColumn("id", F.regexp_extract("subject", shape, 1))
        .filter(F.col("id") != "")
        .groupBy("id")
        .agg(F.sum("pending").cast("bigint").alias("remaining"))
    )
    return ids.join(pending, "id", "left").select("id", F.coalesce("remaining", F.lit(0)).cast("bigint").alias("remaining"))


def experiment_status(documents: DataFrame, depths: DataFrame | None, prefix: str = SUBJECT_PREFIX) -> DataFrame:
    """(id, created, total, remaining, completed); a missing document counts as total 0."""
    left = remaining(depths, documents, prefix)
    total = F.coalesce("total_urls", F.lit(0)).cast("bigint")
    known = (F.col("remaining") >= 0) & (F.col("total") > 0)
    return (
        documents.join(left, "id")
        .select("id", F.col("timestamp").alias("created"), total.alias("total"), "remaining")
        .withColumn("completed", F.when(known, F.col("total") - F.col("remaining")).otherwise(F.lit(0)))
    )


def listed_documents(listed: DataFrame, documents: DataFrame) -> DataFrame:
    """Every listed experiment (id) with its document; those whose document cannot be read have none of its columns."""
    return listed.select("id").join(documents, "id", "left")


def status_table(status: DataFrame) -> DataFrame:
    """Text columns of the status view, newest id first."""
    empty, unknown, done = F.col("total") == 0, F.col("remaining") == -1, F.col("remaining") == 0
    share = F.round(F.col("completed").cast("double") / F.col("total") * 100, 1)
    state = F.when(empty, F.lit("Error/Empty")).when(unknown, F.lit("Queue N/A")).when(done, F.lit("Done")).otherwise(F.lit("Running"))
    progress = (
        F.when(empty | unknown, F.lit("N/A")).when(done, F.lit("100.0%")).otherwise(F.concat(F.format_string("%.1f", share), F.lit("%")))
    )
    finished = F.when(unknown, F.lit("?")).otherwise(F.col("completed").cast("string"))
    created = F.coalesce(F.date_format("created", "yyyy-MM-dd HH:mm"), F.lit("Unknown"))
    return status.select(
        "id",
        state.alias("status"),
        progress.alias("progress"),
        F.concat(finished, F.lit("/"), F.col("total").cast("string")).alias("done_total"),
        created.alias("created"),
    ).orderBy(F.desc("id"))
