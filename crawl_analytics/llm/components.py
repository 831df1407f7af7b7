"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(links: DataFrame) -> tuple[int, int]:
    seen = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return seen["n"], int(seen["s"] or 0)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (id, root) for every id that has a link, root the smallest id reachable.

    Large star: every node hands its larger neighbours to the smallest id it knows.
    Small star: every node hands its smaller neighbours to the smallest one. Repeated
    until the links no longer change, which takes about log(n) rounds; then each links
    a node to its root. The smallest neighbour is a map-side combined minimum, and
    the joins are plain equi-joins, so a hub's links are split by adaptive execution and
    never gathered. Each round is a table in the shared folder; the driver sees two numbers
    a round. Links from an id to itself and NULL ids are left out.
    """
    plain = links.where("a is not null and b is not null and a != b")
    now = stored(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a != b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        last, state = state, _state(now)
        if state == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
