"""Running position inside a group without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CUTS = 256
TIE_BUCKETS = 64


def running_number(
    rows: DataFrame, group: list[str], order: str, spread: list[str], into: str, ties: int = TIE_BUCKETS, cuts: int = CUTS
) -> DataFrame:
    """1-based position of a row in its group by the bigint column ``order``.

    The order axis is cut at up to 256 values taken from the data, so a bucket
    holds a small share of all rows even when one group has most of them. A value
    frequent enough to be a cut is a bucket of its own, split further by a hash of
    ``spread``. NULL comes last; rows with one value follow a hash of ``spread``, whatever the cuts are. Rows are numbered inside the buckets and shifted by the number of
    rows in earlier buckets. Only the cuts, a bounded list, reach the driver; they
    are taken once, so all tasks agree on the buckets.
    """
    steps = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    found = rows.agg(F.percentile_approx(order, steps, F.lit(cuts * 40)).alias("c")).first()["c"] or []
    points = F.array(*[F.lit(v).cast("bigint") for v in sorted(set(found))]).cast("array<bigint>")
    value = F.col(order)
    before = F.when(value.isNull(), F.lit(cuts + 1)).otherwise(F.size(F.filter(points, lambda p: p < value)))
    tied = F.coalesce(F.array_contains(points, value), F.lit(False))
    tie = F.pmod(F.xxhash64(*spread), F.lit(ties)).cast("int")
    split = tied | value.isNull()
    placed = rows.withColumn("__b", before * 2 + tied.cast("int")).withColumn("__t", F.when(split, tie).otherwise(F.lit(0)))
    place = [*group, "__b", "__t"]
    counts = placed.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    # at most (2 * cuts) * ties rows per group reach this window
    earlier = W.partitionBy(*group).orderBy("__b", "__t").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy(*place).orderBy(order, tie, *spread))
    numbered = placed.withColumn("__i", inside).join(shift, place)
    return numbered.withColumn(into, (F.col("__i") + F.col("__shift")).cast("bigint")).drop("__b", "__t", "__i", "__shift")
