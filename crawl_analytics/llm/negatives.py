"""Hard-negative mining: means and deviations of vector segments bound inner products before any is computed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.joins import is_small
from .common import stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
SCALE = 256
LARGEST, LARGEST_NORM = float(1 << 20), float(1 << 56)  # beyond these a hundred times a score is no long
LEVELS = (1, 4, 16)  # segments of a vector, each level cuts those of the level before
SLACK = 4e-7  # rounding of the stored bounds, as a share of the norms' product
LEAST_BLOCK, LARGEST_BLOCK = 1024, 32768
PIECES = 64  # blocks that a table is cut into, as long as their sizes stay between these two
AT_ONCE = 64  # anchors whose bounds are held as a matrix

ROW = "rid long, vec_id long, label long, size int, q array<int>, means array<float>, deviations array<float>"


def _segments(size: int) -> list[tuple[int, int, int]]:
    """(level, begin, end) of every segment; a vector shorter than a level has as many segments as entries."""
    out = []
    for level, count in enumerate(LEVELS):
        edges = np.linspace(0, size, min(count, size) + 1).astype(int)
        out += [(level, int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment, both times the root of its length: products of them then add up."""
    means, deviations = [], []
    for _, a, b in _segments(q.shape[1]):
        part = q[:, a:b]
        mean = part.mean(axis=1)
        means.append(mean * np.sqrt(b - a))
        deviations.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(deviations, axis=1)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: label and vector not NULL, all components finite; q holds floor(256 * x)."""
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    usable = vectors.where("label is not null and embedding is not null").where(good & (F.size("embedding") > 0))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q")).where(norm < LARGEST_NORM)


def _summarised(rows: DataFrame) -> DataFrame:
    """Each row with its segments' summaries and a number of its own, stored."""

    def add(batches: Iterator) -> Iterator:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):  # vectors of one length are one matrix
                part = batch.filter(pa.array(sizes == size))
                means, deviations = _summaries(_matrix(part.column("q"), np.float64, int(size)))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.astype(np.float32).ravel()), m.shape[1]).cast(pa.list_(pa.float32())) for m in (means, deviations)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "means", "deviations"])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.size("q").alias("size"), "q")
    return stored(numbered.mapInArrow(add, ROW), "segment-summaries")


def _matrix(column: pa.Array, kind: type, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)


class Block:
    """Rows of a cell as matrices, in the order that settles ties: vec_id, NULL last, then the row's number."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("vec_id").combine_chunks()
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy()
        order = np.lexsort((rows.column("rid").to_numpy(), plain, missing))
        rows = rows.take(pa.array(order))
        self.rows, self.rid, self.label = rows, rows.column("rid").to_numpy(), rows.column("label").to_numpy()
        self.size = rows.column("size")[0].as_py()
        self.q = _matrix(rows.column("q"), np.float64, self.size)
        segments = _segments(self.size)
        means, deviations = (_matrix(rows.column(c), np.float64, len(segments)) for c in ("means", "deviations"))
        of = np.array([level for level, _, _ in segments])
        self.levels = [(means[:, of == k], deviations[:, of == k]) for k in range(len(LEVELS))]
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))


def _bounds(anchors: Block, a: slice, rows: Block, r: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores: means' product minus and plus the deviations' product."""
    (am, ad), (rm, rd) = anchors.levels[level], rows.levels[level]
    middle, spread = am[a] @ rm[r].T, ad[a] @ rd[r].T
    spread += SLACK * anchors.norm[a][:, None] * rows.norm[r][None, :] + 1
    return middle - spread, middle + spread


def _scores(anchors: Block, a: slice, rows: Block, r: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum is below 2^53, else in 64-bit integers."""
    if anchors.norm.max(initial=0) * rows.norm.max(initial=0) < float(1 << 52):
        return (anchors.q[a] @ rows.q[r].T).astype(np.int64)
    return anchors.q[a].astype(np.int64) @ rows.q[r].astype(np.int64).T


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each line, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _refined(anchors: Block, a: slice, rows: Block, alive: np.ndarray, still: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, wanted pairs) left after all levels; ``still`` says from the bounds which pairs stay.

    A row leaves as soon as no anchor of the slice wants it, so finer levels see fewer rows.
    """
    r = np.flatnonzero(alive.any(axis=0))
    alive = alive[:, r]
    for level in range(len(LEVELS)):
        if not len(r):
            break
        least, largest = _bounds(anchors, a, rows, r, level)
        alive &= still(least, largest, alive)
        stay = alive.any(axis=0)
        r, alive = r[stay], alive[:, stay]
    return r, alive


def _best_of_label(anchors: Block, rows: Block, wanted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): for every anchor its first ``wanted`` rows, itself excluded."""
    for begin in range(0, len(anchors.rid), AT_ONCE):
        a = slice(begin, begin + AT_ONCE)

        def still(least, largest, alive):
            enough = _kth(np.where(alive, least, -np.inf), wanted)  # so many rows score this at least
            return largest >= enough[:, None]

        r, alive = _refined(anchors, a, rows, anchors.rid[a][:, None] != rows.rid[None, :], still)
        scores = _scores(anchors, a, rows, r)
        for i in range(len(scores)):
            at = np.flatnonzero(alive[i])
            first = at[np.argsort(-scores[i, at], kind="stable")[:wanted]]
            yield begin + i, r[first], scores[i, first]


def _best_in_bands(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, wanted: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, band, rows, scores): for every anchor and band its first ``wanted`` rows of another label with a score in the band."""
    for begin in range(0, len(anchors.rid), AT_ONCE):
        a = slice(begin, begin + AT_ONCE)
        lo, hi = low[a], high[a]

        def still(least, largest, alive):  # noqa: B023
            stay = np.zeros_like(alive)
            for band in range(lo.shape[1]):
                l, h = lo[:, band, None], hi[:, band, None]  # noqa: B023, E741
                inside = alive & (least >= l) & (largest <= h)  # surely in the band: these set what is enough
                enough = _kth(np.where(inside, least, -np.inf), wanted) if inside.any() else np.full(len(alive), -np.inf)
                stay |= (largest >= np.maximum(l, enough[:, None])) & (least <= h)
            return stay

        r, alive = _refined(anchors, a, rows, anchors.label[a][:, None] != rows.label[None, :], still)
        scores = _scores(anchors, a, rows, r)
        for i in range(len(scores)):
            at = np.flatnonzero(alive[i])
            at = at[np.argsort(-scores[i, at], kind="stable")]
            falling = -scores[i, at]
            for band in range(lo.shape[1]):
                first, end = np.searchsorted(falling, -hi[i, band]), np.searchsorted(falling, -lo[i, band], side="right")
                if first < end:
                    chosen = at[first : min(end, first + wanted)]
                    yield begin + i, band, r[chosen], scores[i, chosen]


def _per_block(n: Column, pieces: int) -> Column:
    return F.least(F.greatest(F.ceil(n / pieces), F.lit(LEAST_BLOCK)), F.lit(LARGEST_BLOCK))


def _cells(rows: DataFrame, anchors: DataFrame, keys: list[str]):
    """Rows and anchors dealt to the cells of a grid: every row block of a key meets every anchor block of that key once.

    Blocks grow with the table up to ``LARGEST_BLOCK`` rows, so a row is sent once for so many anchors and a hot key is many cells.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    parts = counts.join(few, keys).select(
        *keys, F.ceil(F.col("n") / _per_block(F.col("n"), PIECES)).alias("row_parts"), F.ceil(F.col("m") / _per_block(F.col("m"), PIECES)).alias("anchor_parts")
    )
    parts = stored(parts, "grid-parts")
    parts = F.broadcast(parts) if is_small(parts) else parts
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    left = rows.join(parts, keys).withColumn("row_part", own("row_parts")).withColumn("anchor_part", every("anchor_parts"))
    right = anchors.join(parts, keys).withColumn("anchor_part", own("anchor_parts")).withColumn("row_part", every("row_parts"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own beside those of the same table
    cell = [*keys, "row_part", "anchor_part"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell))


def _positives(table: DataFrame, anchors: DataFrame, wanted: int) -> DataFrame:
    """(anchor, place, positive_id, positive_score): the first rows of each anchor's label; rows of other labels are never met."""

    def compare(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"anchor": [], "rid": [], "score": [], "positive_id": []}
        if rows.num_rows and asking.num_rows:
            block, ask = Block(rows), Block(asking)
            for i, found, scores in _best_of_label(ask, block, wanted):
                out["anchor"] += [int(ask.rid[i])] * len(found)
                out["rid"] += block.rid[found].tolist()
                out["score"] += scores.tolist()
                out["positive_id"] += block.rows.column("vec_id").take(pa.array(found)).to_pylist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    found = _cells(table, anchors, ["size", "label"]).applyInArrow(compare, "anchor long, rid long, score long, positive_id long")
    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "rid")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    return first.select("anchor", "place", "positive_id", F.col("score").alias("positive_score"))


def mined(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` holds vec_id, label and whole-number vectors q (see ``whole_numbers``); ``anchor`` says which rows ask. An anchor's
    positives are the first rows of its label, its negatives for a positive the first rows of other labels that score ``low`` to
    ``high`` per cent of the positive. Every row but the anchor itself may be either, repeated rows each for themselves;
    order is the score, then vec_id, NULL last. Only vectors of one length have a score. No row is left out unless its bounds show
    that it cannot be among the first. A vector of a component beyond 2^20 or of squared norm 2^56 and more has no
    exact score and takes no part (``whole_numbers``). Anchors without a positive, or positives without a negative, give no row.
    """
    table = _summarised(rows)
    asking = table.where(anchor)
    found = stored(_positives(table, asking, positives), "anchor-positives")
    # whole bounds: low * positive <= 100 * negative <= high * positive
    bands = found.select(
        "anchor",
        F.struct(
            "place",
            "positive_id",
            "positive_score",
            F.ceil((F.col("positive_score") * low).cast("decimal(20,0)") / 100).cast("long").alias("lo"),
            F.floor((F.col("positive_score") * high).cast("decimal(20,0)") / 100).cast("long").alias("hi"),
        ).alias("band"),
    )
    bands = bands.where("band.lo <= band.hi").groupBy("anchor").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    banded = asking.join(bands, asking["rid"] == bands["anchor"]).drop("anchor")
    names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "rid", "negative_score"]

    def compare(block_rows: pa.Table, ask_rows: pa.Table) -> pa.Table:
        out = {k: [] for k in names}
        if block_rows.num_rows and ask_rows.num_rows:
            block, ask = Block(block_rows), Block(ask_rows)
            lists = ask.rows.column("bands").to_pylist()
            lo = np.full((len(lists), positives), np.iinfo(np.int64).max)
            hi = np.full((len(lists), positives), np.iinfo(np.int64).min + 1)
            for i, mine in enumerate(lists):
                lo[i, : len(mine)], hi[i, : len(mine)] = [b["lo"] for b in mine], [b["hi"] for b in mine]
            ids = ask.rows.column("vec_id").to_pylist()
            for i, band, chosen, scores in _best_in_bands(ask, block, lo, hi, negatives):
                of = lists[i][band]
                for key, value in (("anchor", int(ask.rid[i])), ("anchor_id", ids[i]), ("place", of["place"]), ("positive_id", of["positive_id"]), ("positive_score", of["positive_score"])):
                    out[key] += [value] * len(chosen)
                out["negative_id"] += block.rows.column("vec_id").take(pa.array(chosen)).to_pylist()
                out["rid"] += block.rid[chosen].tolist()
                out["negative_score"] += scores.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    kept = _cells(table, banded, ["size"]).applyInArrow(compare, ", ".join(f"{n} long" for n in names))
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "rid")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
