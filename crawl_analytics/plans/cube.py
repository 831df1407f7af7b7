"""A stored cube of the site summary: mergeable states per cell, from which any dimensions and measures are answered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import new_run_dir

SKETCH_BITS = 14  # 2^14 registers: a relative standard error of 0.8 %
COUNTS = ["total_network_requests", "total_trackers_loaded"]


@dataclass(frozen=True)
class Cube:
    """Cells below ``path``: a table per grouping, the first with all dimensions."""

    spark: SparkSession
    path: str
    groupings: list[list[str]]

    def query(self, dims: list[str], measures: list[str], where: dict[str, object] | None = None) -> DataFrame:
        """Measures by dimensions, of the cells whose dimensions have the values in ``where`` (None: no value).

        Only the grouping with the fewest dimensions that has all those asked for is read. Counts are added up, sketches and bitmaps united; seeds are counted exactly.
        """
        needed = {*dims, *(where or {})}
        unknown = needed - set(self.groupings[0])
        if unknown:
            raise KeyError(f"unknown dimensions: {sorted(unknown)}")
        known = {*COUNTS, "unique_domains_contacted", "total_seed_domains"}
        if set(measures) - known:
            raise KeyError(f"unknown measures: {sorted(set(measures) - known)}")
        number = min((i for i, g in enumerate(self.groupings) if needed <= set(g)), key=lambda i: len(self.groupings[i]))

        def part(table: str) -> DataFrame:
            rows = self.spark.read.parquet(f"{self.path}/{table}-{number}")
            for name, value in (where or {}).items():
                rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
            return rows

        found = _merged(part("cells"), dims)
        if "unique_domains_contacted" in measures:
            found = found.withColumn("unique_domains_contacted", F.hll_sketch_estimate("domains"))
        if "total_seed_domains" in measures:
            bits = _united(part("seeds"), dims).groupBy(*dims).agg(F.sum(F.bitmap_count("bits")).alias("total_seed_domains"))
            same = [found[d].eqNullSafe(bits[d]) for d in dims]
            seeds = F.coalesce(bits["total_seed_domains"], F.lit(0)).cast("bigint").alias("total_seed_domains")
            both = found.join(bits, same, "left") if dims else found.crossJoin(bits)  # without dimensions: one row each
            found = both.select(*[found[c] for c in found.columns], seeds)
        return found.select(*dims, *measures)


def _merged(cells: DataFrame, by: list[str | Column]) -> DataFrame:
    # as the view's measures: without rows requests are 0, trackers NULL
    sums = [F.coalesce(F.sum(COUNTS[0]), F.lit(0)).cast("bigint").alias(COUNTS[0]), F.sum(COUNTS[1]).cast("bigint").alias(COUNTS[1])]
    return cells.groupBy(*by).agg(*sums, F.hll_union_agg("domains").alias("domains"))


def _united(seeds: DataFrame, by: list[str | Column]) -> DataFrame:
    return seeds.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def seed_numbers(summary: DataFrame) -> DataFrame:
    """(seed_domain, seed): whole numbers from 0 without gaps, in hash order: distinct seeds dealt by a hash, numbered in each part."""
    spark = summary.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seeds = summary.where("seed_domain is not null").select("seed_domain").distinct()
    path = new_run_dir(spark, "seeds")
    seeds.withColumn("part", F.pmod(F.xxhash64("seed_domain"), F.lit(parts)).cast("int")).write.parquet(path)
    dealt = spark.read.schema("seed_domain string, part int").parquet(path)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per part
    starts, at = [], 0
    for part in range(parts):
        starts.append(at)
        at += sizes.get(part, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("part") + 1)
    inside = F.row_number().over(W.partitionBy("part").orderBy("seed_domain"))
    return dealt.select("seed_domain", (start + inside - 1).cast("bigint").alias("seed"))


def build_cube(summary: DataFrame, path: str, dims: list[str], rollups: list[list[str]] | None = None) -> Cube:
    """Store the cube of an enriched site summary (``copies`` weighs its rows) over ``dims`` and the smaller groupings asked for.

    The rows are read once for the cells of all dimensions: counts, an HLL sketch of the contacted domains, and the numbers of the
    seeds as bitmaps of 32,768 bits, so that distinct seeds can be united exactly. Rollups are made from these cells, not from
    the rows. Partial states are combined on the map side: a cell
    with a third of the rows is one state per task. Cells of a NULL dimension are cells like any other.
    """
    unknown = [r for r in rollups or [] if not set(r) <= set(dims)]
    if unknown:
        raise KeyError(f"rollups beyond the dimensions: {unknown}")
    spark = summary.sparkSession
    groupings = [list(dims), *[list(r) for r in rollups or []]]
    weight = F.col("copies") if "copies" in summary.columns else F.lit(1).cast("bigint")
    needed = dict.fromkeys([*dims, "request_is_tracker", "seed_domain"])
    rows = summary.select(*needed, F.col("request_requested_domain").alias("__domain"), weight.alias("__weight"))
    cells = rows.groupBy(*dims).agg(
        F.sum("__weight").cast("bigint").alias(COUNTS[0]),
        F.sum(F.when(F.col("request_is_tracker"), F.col("__weight")).otherwise(F.lit(0))).cast("bigint").alias(COUNTS[1]),
        F.hll_sketch_agg("__domain", SKETCH_BITS).alias("domains"),
    )
    numbered = rows.select(*dict.fromkeys([*dims, "seed_domain"])).distinct().join(seed_numbers(summary), "seed_domain")
    bits = numbered.groupBy(*dims, F.bitmap_bucket_number("seed").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seed")).alias("bits"))
    for table, finest, merge in (("cells", cells, _merged), ("seeds", bits, _united)):
        finest.write.mode("overwrite").parquet(f"{path}/{table}-0")
        stored = spark.read.schema(finest.schema).parquet(f"{path}/{table}-0")
        for number, kept in enumerate(groupings[1:], 1):
            merge(stored, kept).write.mode("overwrite").parquet(f"{path}/{table}-{number}")
    return Cube(spark, path, groupings)
