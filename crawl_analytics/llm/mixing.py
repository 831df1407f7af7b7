"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.joins import is_small
from .common import WORD, blocks_for, stored, unused

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
LONG_SHARE = 1000  # a document with more than 1/1000 of its source's words is dealt before the others
BLOCK_ROWS = 4_000
HASH_DIGITS = 15
# Weight schedules by rank of the source, repeating: (progress, multiple of the mean rate).
# The first sources fade, the second hold, the third grow; each is scaled so that its integral over [0, 1] is 1.
SCHEDULES = (
    ((0.0, 1.3), (0.5, 1.1), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)),
)


def words(text: str = "text") -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with rank, weight and target: shares of the whole size by weight, none above ``most`` sizes.

    Resharing what is above a limit until none is above ends at the level L where the minima of limit and weight * L
    sum to the whole. Sources at their limit are those with the smallest limit per weight, so L follows
    from running sums over one row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("rank", rank).withColumn("weight", weight)
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    # the level of the first source that stays below its limit
    reached = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * reached["level"])
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def _segments(schedule) -> list[tuple[float, float, float, float]]:
    """(progress, demand met by then, rate, slope of the rate) of each piece of a scaled schedule."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))
    out, met = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        out.append((t0, met, r0 / whole, (r1 - r0) / whole / (t1 - t0)))
        met += (t1 - t0) * (r0 + r1) / 2 / whole
    return out


def position(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training progress at which a source has delivered ``share`` of its target: its integrated schedule, inverted."""
    kinds = []
    for schedule in schedules:
        pieces = [F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("tmrs", s, strict=True)]) for s in _segments(schedule)]
        kinds.append(F.array(*pieces))
    pieces = F.element_at(F.array(*kinds), (F.pmod(rank, F.lit(len(schedules))) + 1).cast("int"))
    here = F.element_at(F.filter(pieces, lambda s: s["m"] <= F.greatest(share, F.lit(0.0))), -1)
    rest = share - here["m"]
    root = F.sqrt(F.greatest(here["r"] * here["r"] + 2 * here["s"] * rest, F.lit(0.0)))
    # rest = r * x + s * x * x / 2, in the form that also holds for s = 0
    return F.least(here["t"] + 2 * rest / F.nullif(here["r"] + root, F.lit(0.0)), F.lit(1.0))


def _dealt(units: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Order of the units in their source and how often each is taken.

    Units are dealt by a hash of the doc_id, long documents first in proportion, the others until the target is met:
    then a long document at the end of a round cannot carry the source far from its target. Running sums are taken in
    two steps, inside blocks of the hash range and over the blocks, so a source with most rows is many tasks.
    """
    rows = units.count()
    blocks = blocks_for(rows, BLOCK_ROWS)
    known = F.broadcast(sources) if is_small(sources) else sources
    placed = units.join(known, units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("is_short", (F.col("size") * LONG_SHARE <= F.col("source_size")).cast("int"))
    span = (16**HASH_DIGITS) // blocks + 1
    placed = placed.withColumn("block", F.floor(F.col("h") / F.lit(span)).cast("long"))
    group = ["rank", "is_short"]
    sums = placed.groupBy(*group, "block").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    over = W.partitionBy(*group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(over), F.lit(0)))
    sums = sums.withColumn("class_size", F.sum("words").over(W.partitionBy(*group))).drop("words")
    inside = W.partitionBy(*group, "block").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("in_block", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    placed = placed.join(sums, [*group, "block"])
    return placed.withColumn("begin", F.col("before") + F.col("in_block")).drop("before", "in_block")


def _copies(dealt: DataFrame, sources: DataFrame) -> DataFrame:
    """Copies of a unit: the whole rounds of the target, and one more as long as the last, partial round lasts."""
    whole = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) + F.lit(1e-12))
    rows = dealt.withColumn("rounds", F.coalesce(whole, F.lit(0)).cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    # a unit is in when its middle lies before the end: the nearest cut in whole documents
    middle = F.col("begin") + F.col("size") * F.col("n") / 2.0
    long_end = F.col("rest") * F.col("class_size") / F.nullif(F.col("source_size"), F.lit(0))
    rows = rows.withColumn("long_in", (F.col("is_short") == 0) & (F.col("size") > 0) & (middle < long_end))
    taken = rows.where("long_in").groupBy("rank").agg(F.sum(F.col("size") * F.col("n")).alias("long_words"))
    rows = rows.join(F.broadcast(taken) if is_small(sources) else taken, "rank", "left")
    short_in = (F.col("is_short") == 1) & (F.col("size") > 0) & (middle < F.col("rest") - F.coalesce("long_words", F.lit(0)))
    once = F.coalesce(F.col("long_in") | short_in, F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("rounds") + once.cast("long")).otherwise(F.lit(0))
    # how far the unit's middle lies into a whole round and into the partial one
    partial_end = F.when(F.col("is_short") == 1, F.col("rest") - F.coalesce("long_words", F.lit(0))).otherwise(long_end)
    rows = rows.withColumn("copies", copies.cast("long")).withColumn("into_round", middle / F.nullif(F.col("class_size"), F.lit(0)))
    return rows.withColumn("into_rest", F.when(once, middle / partial_end))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """doc_id, source, size, text_hash, n, source_size, target, copies, positions: one row per distinct document.

    ``n`` rows of ``docs`` share the first four. ``positions`` holds the training progress, 0 to 1, of every copy: the k-th round of a
    source through its integrated weight schedule. Texts are read once; all else works on these narrow rows.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words().alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("text_hash").cast("string")))), 1, HASH_DIGITS)
    units = narrow.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    units = stored(units.withColumn("h", F.conv(digits, 16, 10).cast("long")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = stored(targets(sizes, weights, most), "mix-sources")
    dealt = _copies(_dealt(units, sources, most), sources)
    turns = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<bigint>"))

    def delivered(k: Column) -> Column:
        """The share of its target that the source has delivered when the k-th copy is half through."""
        whole = (k - 1 + F.col("into_round")) * F.col("source_size")
        last = F.col("rounds") * F.col("source_size") + F.col("into_rest") * F.col("rest")
        return F.least(F.when(k <= F.col("rounds"), whole).otherwise(last) / F.col("target"), F.lit(1.0))

    positions = F.transform(turns, lambda k: position(delivered(k), F.col("rank"), schedules))
    return dealt.select("doc_id", "source", "size", "text_hash", "n", "source_size", "target", "copies", positions.alias("positions"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions; one row per row of ``docs``, range-sorted by first position.

    size counts words, source_size and target are its source's, taken is copies * size. Documents without words are never taken.
    NULL texts have size 0, documents without a source are the last source, those without a doc_id are ordered by
    their text, repeated rows are taken equally often. Other columns are ignored; an empty table gives an
    empty result. The order hash depends on the data alone, so reruns agree.
    """
    planned = plan(docs)
    rows = planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "positions")
    return out.orderBy(F.try_element_at("positions", F.lit(1)), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The training stream: every taken copy of every document with all columns of ``docs``, in range-sorted files.

    Decisions join back on (doc_id, text hash); a document with a doc_id of its own finds one row.
    """
    names = ["doc_id", "source", "text_hash", "positions"]
    own = {name: unused(docs, f"mix_{name}") for name in names}
    decided = plan(docs).where("copies > 0").select(*[F.col(name).alias(own[name]) for name in names])
    text_hash, position_ = unused(docs, "mix_own_hash"), unused(docs, "mix_position")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    same = (
        keyed["doc_id"].cast("long").eqNullSafe(decided[own["doc_id"]])
        & keyed["source"].cast("string").eqNullSafe(decided[own["source"]])
        & (keyed[text_hash] == decided[own["text_hash"]])
    )
    copies = keyed.join(decided, same).withColumn(position_, F.explode(own["positions"]))
    return copies.orderBy(position_, text_hash).select(*[F.col(c) for c in docs.columns])
