"""Joins and reductions that hold up when one key has a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

BUCKETS = 65536
TASKS: int | None = None  # tasks that share a join; the session's shuffle partitions unless set
HOT_ROWS = 200_000  # a bucket with fewer rows than this is never split
LOOKUP_ROWS = 2_000_000
LOOKUP_CHARS = 32_000_000


def group_by(rows: DataFrame, keys: list[str]) -> GroupedData:
    """``groupBy`` with a hash of the keys before them (``__hash`` in the result).

    Minima of texts and structs are taken over sorted rows. A sort compares the first eight bytes of the first key and opens
    both rows where these are equal; URLs and experiments all begin alike, hashes do not.
    """
    return rows.groupBy(F.xxhash64(*keys).alias("__hash"), *keys)


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` with NULL last, ties settled by the remaining columns.

    A minimum of a struct is combined on the map side, so a key with many rows
    sends one row per map task and never meets in one task whole.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    if not order and not rest:
        return rows.distinct()
    placed = [part for i, c in enumerate(order) for part in (F.col(c).isNull().alias(f"__no_{i}"), F.col(c))]
    best = group_by(rows, keys).agg(F.min(F.struct(*placed, *rest)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order``, ties settled by the remaining columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = group_by(rows, keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(
    rows: DataFrame, keys: list[list[str]], min_rows: int | None = None, weight: str | None = None
) -> list[dict[int, int]]:
    """For each key, {hash bucket: parts} of the buckets with more rows than one task's share of all rows.

    A share is the number of rows by the number of shuffle partitions, ``min_rows`` at least; a bucket gets as many parts
    as it has shares, so parts stay alike however large the table and the key are. There are fewer such
    buckets than partitions. Counting buckets instead of keys keeps the map-side state and the
    shuffle bounded. A hot key makes its bucket hot. One job serves several keys and reads the key
    columns only; its result is a constant of the plan, so all tasks agree on it. ``weight`` names a
    column with the number of rows a row stands for.
    """
    min_rows = HOT_ROWS if min_rows is None else min_rows
    tasks = TASKS or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.sum("w") if weight else F.count(F.lit(1))
    places = F.array(*[F.struct(F.lit(i).alias("k"), _bucket(key).alias("b")) for i, key in enumerate(keys)])
    placed = rows.select(F.explode(places).alias("p"), *([F.col(weight).alias("w")] if weight else []))
    counts = placed.groupBy("p.k", "p.b").agg(n.alias("n"))
    large = F.collect_list(F.when(F.col("n") >= min_rows, F.struct("k", "b", "n")))
    found = counts.agg(F.sum("n").alias("all"), large.alias("large")).first()
    share = max(min_rows, (found["all"] or 0) / len(keys) / tasks)
    return [{r["b"]: math.ceil(r["n"] / share) for r in found["large"] if r["k"] == i and r["n"] > share} for i in range(len(keys))]


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    hot: dict[int, int] | None = None,
    hot_on: list[str] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Equi-join of a large side with a side that may be large too.

    Without hot buckets this is a plain join. Else fact rows of hot buckets get a
    salt from a hash of ``spread`` (all columns by default), and the other side's
    rows of these buckets are repeated once per part. Salts come from the row's
    content, so a recomputed task sends every row to the same place again. ``hot``
    holds buckets found before, on a table with the same key frequencies and types;
    ``hot_on`` says which part of the key they are buckets of. A hash of the key stands before it, as in ``group_by``.
    Works for inner, left, left_semi and left_anti.
    """
    kinds = {c: facts.schema[c].dataType for c in on}
    dim = dim.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in dim.columns])
    if hot is None:
        hot = hot_buckets(facts, [on], min_rows)[0]
    whole = F.xxhash64(*on)
    if not hot:
        return facts.withColumn("__hash", whole).join(dim.withColumn("__hash", whole), ["__hash", *on], how).drop("__hash")
    table = F.expr(f"map({', '.join(f'{b}, {n}' for b, n in sorted(hot.items()))})")
    parts = F.coalesce(F.try_element_at(table, _bucket(hot_on or on)), F.lit(1))
    salt = F.pmod(F.xxhash64(F.lit(7), *(spread or facts.columns)), parts).cast("int")
    left = facts.withColumns({"__salt": salt, "__hash": whole})
    right = dim.withColumns({"__salt": F.explode(F.sequence(F.lit(0), parts - 1)), "__hash": whole})
    return left.join(right, ["__hash", *on, "__salt"], how).drop("__hash", "__salt")


def is_small(lookup: DataFrame, max_rows: int | None = None, max_chars: int | None = None) -> bool:
    """Measure a lookup: at most ``max_rows`` rows and ``max_chars`` characters of text."""
    max_rows = LOOKUP_ROWS if max_rows is None else max_rows
    max_chars = LOOKUP_CHARS if max_chars is None else max_chars
    texts = [f.name for f in lookup.schema.fields if f.dataType.typeName() in ("string", "array")]
    chars = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0))
    seen = lookup.agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars")).first()
    return seen["n"] <= max_rows and (seen["chars"] or 0) <= max_chars


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    hot_rows: DataFrame | None = None,
) -> DataFrame:
    """Join with a lookup: broadcast once it is measured to be small, salted shuffle join beyond that.

    ``hot_rows`` names a cheaper table with the same key frequencies and types.
    """
    if is_small(lookup):
        return facts.join(F.broadcast(lookup), on, how)
    hot = None if hot_rows is None else hot_buckets(hot_rows, [on])[0]
    return salted_join(facts, lookup, on, how, hot=hot)


def repeat_rows(rows: DataFrame, times: str) -> DataFrame:
    """Emit every row ``times`` times. Two levels of explode keep the arrays short."""
    step = 4096
    n = F.col(times)
    few = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / step))))
    size = F.least(F.lit(step).cast("bigint"), n - F.col("__block") * step)
    return few.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).drop("__block", "__copy", times)
