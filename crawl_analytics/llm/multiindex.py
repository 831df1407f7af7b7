"""Embedding near-duplicates by an inverted multi-index: two codebooks, a product grid, multi-sequence visits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import is_small
from .common import share, stored
from .components import components

THRESHOLD = 0.93
RECALL = 0.99  # of the true links of the measured queries
CELL_ROWS = 16  # vectors of a label in a cell, about, as far as MOST_WORDS allows
FEWEST_WORDS, MOST_WORDS = 4, 512
SAMPLE_PER_WORD = 60
QUERIES = 512
LINKS = 400  # links that the queries must have seen until their recall counts alone
MOST_QUERIES = 8192
MOST_VISITS = 512  # at first; more if they miss the recall
VISIT_ENTRIES = 1 << 23  # candidate cells of the vectors that are ranked at once
BLOCK = 2048  # vectors on either side of one comparison
GRID_ROWS = 256  # a length with no more different vectors has no grid: they are compared in one cell


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centers = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = (points @ centers.T - (centers * centers).sum(axis=1) / 2).argmax(axis=1)
        for i in range(len(centers)):
            if (mine := points[own == i]).size:
                centers[i] = mine.mean(axis=0)
    return centers


class Grid:
    """A codebook for each half of the vectors; a cell is a word of the first and one of the second."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)

    def visits(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of every vector, nearest first, in the order of the multi-sequence algorithm.

        The cell of the i-th nearest first word and the j-th nearest second word comes after the (i * j - 1) cells that
        are nearer in both, so only cells with i * j <= most can be among them.
        """
        pairs = sum(min(len(self.books[1]), most // i) for i in range(1, len(self.books[0]) + 1))
        if len(vectors) > (rows := max(1, VISIT_ENTRIES // max(1, pairs))):
            return np.concatenate([self.visits(vectors[at : at + rows], most) for at in range(0, len(vectors), rows)])
        unit, half = _unit(vectors), self.books[0].shape[1]
        far, order = [], []
        for part, book in zip((unit[:, :half], unit[:, half:]), self.books, strict=True):
            d = (book * book).sum(axis=1) - 2 * part @ book.T
            at = np.argsort(d, axis=1, kind="stable")
            order.append(at)
            far.append(np.take_along_axis(d, at, axis=1))
        i, j = np.meshgrid(np.arange(len(self.books[0])), np.arange(len(self.books[1])), indexing="ij")
        near = ((i + 1) * (j + 1) <= most).ravel()
        i, j = i.ravel()[near], j.ravel()[near]
        sums = far[0][:, i] + far[1][:, j]
        first = np.argsort(sums, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(order[0][:, i], first, axis=1) * len(self.books[1]) + np.take_along_axis(order[1][:, j], first, axis=1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray | pa.LargeListArray) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def comparable(vectors: DataFrame) -> DataFrame:
    """Rows that can have links: label and embedding not NULL, no NULL or non-finite component, not all zero."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vectors.where("label is not null and embedding is not null").where(finite).where(F.exists("embedding", lambda x: x != 0))


def _trained(classes: DataFrame, size: int, rows: int, labels: int) -> Grid:
    words = int(np.clip(round((rows / max(1, labels) / CELL_ROWS) ** 0.5), FEWEST_WORDS, MOST_WORDS))
    wanted = SAMPLE_PER_WORD * words
    sample = classes.where(share("low", "id", seed=3) < F.lit(min(1.0, wanted / max(1, rows)))).select("id", "embedding")
    points = _unit(np.array([r["embedding"] for r in sample.orderBy("id").collect()] or np.eye(max(2, size))[:1], dtype=np.float64))
    half = size // 2
    return Grid(_k_means(points[:, :half], words), _k_means(points[:, half:], words))


def _rank(lists: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The place of each cell in its list, from one; one more than the list's length if it is not there."""
    hit = lists == cell[:, None]
    return np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, lists.shape[1] + 1)


def _measured(classes: DataFrame, grid: Grid, size: int, most: int, threshold: float, chosen: list) -> np.ndarray:
    """How many links of the ``chosen`` vectors each number of visits is the smallest to find; at ``most + 1`` those not found."""
    ids = np.array([r["id"] for r in chosen])
    labels = np.array([r["label"] for r in chosen])
    raw = np.array([r["embedding"] for r in chosen], dtype=np.float64)
    query, seen = _unit(raw), grid.visits(raw, most)

    def measure(batches: Iterator) -> Iterator:
        found = np.zeros(most + 2, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = _vectors(part.column("embedding"), size)
                same = part.column("label").to_numpy(zero_copy_only=False)[:, None] == labels[None, :]
                near = (_unit(own) @ query.T >= threshold) & same & (part.column("id").to_numpy()[:, None] != ids[None, :])
                i, j = np.nonzero(near)
                for a in range(0, len(i), 4096):
                    rows, x = np.unique(i[a : a + 4096], return_inverse=True)
                    y = j[a : a + 4096]
                    lists = grid.visits(own[rows], most)
                    found += np.bincount(np.minimum(_rank(seen[y], lists[x, 0]), _rank(lists[x], seen[y, 0])), minlength=most + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(most + 2)), pa.array(found)], names=["visits", "n"])

    counts = classes.select("id", "label", "embedding").mapInArrow(measure, "visits long, n long").groupBy("visits").agg(F.sum("n").alias("n"))
    out = np.zeros(most + 2, dtype=np.int64)
    for r in counts.collect():
        out[r["visits"]] = r["n"]
    return out


def _perturbed(chosen: list, grid: Grid, most: int, threshold: float) -> np.ndarray:
    """As ``_measured``, for links made from the chosen vectors: each with one at exactly ``threshold`` in a random direction."""
    unit = _unit(np.array([r["embedding"] for r in chosen], dtype=np.float64))
    side = np.random.default_rng(6).normal(size=unit.shape)
    side = _unit(side - (side * unit).sum(axis=1)[:, None] * unit)
    other = threshold * unit + (1 - threshold**2) ** 0.5 * side
    a, b = grid.visits(unit, most), grid.visits(other, most)
    return np.bincount(np.minimum(_rank(a, b[:, 0]), _rank(b, a[:, 0])), minlength=most + 2)


def _visits_for(classes: DataFrame, grid: Grid, size: int, rows: int, threshold: float, recall: float) -> int:
    """How many cells a vector must visit until ``recall`` of the links are found, measured by brute force.

    A few hundred vectors are compared with all, then further blocks of twice as many until ``LINKS`` links were seen.
    A link counts as found after t visits if either end's cell is among the t nearest of the other. Executors return
    how often each number of visits is the smallest that finds a link. If ``MOST_QUERIES`` queries see too few
    links, vectors perturbed to the threshold must be found as well. Where the most visits miss the recall, twice
    as many are tried, up to all cells.
    """
    cells = len(grid.books[0]) * len(grid.books[1])
    drawn = F.lit(max(1, rows)) * share("low", "id", seed=4)
    most = min(MOST_VISITS, cells)
    blocks, n, begin, step = [], np.zeros(most + 2, dtype=np.int64), 0, QUERIES
    while begin < min(rows, MOST_QUERIES) and n.sum() < LINKS:
        chosen = classes.where((drawn >= begin) & (drawn < begin + step)).orderBy("id").collect()
        begin, step = begin + step, 2 * step
        if chosen:
            blocks.append(chosen)
            n += _measured(classes, grid, size, most, threshold, chosen)
    every = begin >= rows  # all vectors were queries: what they saw is all there is
    if not blocks or (every and not n.sum()):
        return 1
    enough = lambda n: int(np.flatnonzero(np.cumsum(n) >= recall * n.sum())[0])
    few = n.sum() < LINKS and not every
    while True:
        visits = enough(n) if n.sum() else 1
        if few:
            visits = max([visits, *[enough(_perturbed(c, grid, most, threshold)) for c in blocks[:1]]])
        if visits <= most or most >= cells:
            return int(np.clip(visits, 1, most))
        most = min(2 * most, cells)
        n = sum(_measured(classes, grid, size, most, threshold, c) for c in blocks)


def _placed(classes: DataFrame, grid: Grid, size: int, visits: int) -> DataFrame:
    def place(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cells = grid.visits(_vectors(part.column("embedding"), size), visits)
                lists = pa.array(list(cells.astype(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0].astype(np.int64)), lists], names=[*part.schema.names, "home", "visits"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    return classes.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", home long, visits array<long>")


def _compared(groups: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) of the vectors of a block pair that have links: how many, with copies, and a member of their component.

    Every link is counted in one place only: where its larger end visits the home of its smaller end, or, if it does
    not, where the smaller end visits the home of the larger.
    """

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        role = rows.column("role").to_numpy()
        ids, copies, homes = (rows.column(c).to_numpy() for c in ("id", "copies", "home"))
        at, to = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(at) or not len(to):
            return empty
        unit = _unit(_vectors(rows.column("embedding").chunk(0), rows.column("size")[0].as_py()))
        near = unit[at] @ unit[to].T >= threshold
        near &= ids[at][:, None] != ids[to][None, :]
        if not near.any():
            return empty
        lists = rows.column("visits").to_pylist()
        lists = np.array([lists[i] for i in at], dtype=np.int64)
        cells, cell_of = np.unique(homes[to], return_inverse=True)
        sees = np.stack([(lists == c).any(axis=1) for c in cells], axis=1)  # home row x cell of a visitor
        near &= (ids[at][:, None] < ids[to][None, :]) | ~sees[:, cell_of]
        links = np.zeros(len(ids), dtype=np.int64)
        links[at] = near @ copies[to]
        links[to] = near.T @ copies[at]
        a, b = ids[at].copy(), ids[to].copy()
        largest = np.iinfo(np.int64).max
        while True:  # smallest id along the links of this block
            new_a = np.minimum(a, np.where(near, b[None, :], largest).min(axis=1))
            new_b = np.minimum(b, np.where(near, new_a[:, None], largest).min(axis=0))
            if (new_a == a).all() and (new_b == b).all():
                break
            a, b = new_a, new_b
        root = np.zeros(len(ids), dtype=np.int64)
        root[at], root[to] = a, b
        some = links > 0
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})

    return groups.groupBy("label", "size", "cell", "home_part", "visit_part").applyInArrow(compare, "id long, links long, root long")


def _placed_by_length(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """The classes with their home cell and visits: a grid for every length with enough vectors, one cell for the others."""
    counts = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))
    frequent = counts.where((F.col("n") > GRID_ROWS) & (F.col("size") > 1)).orderBy("size").collect()  # each has many rows
    one = F.lit(0).cast("long")
    rest = classes.where(~F.col("size").isin([r["size"] for r in frequent])) if frequent else classes
    placed = rest.withColumns({"home": one, "visits": F.array(one)})
    for r in frequent:
        own = classes.where(F.col("size") == r["size"])
        grid = _trained(own, r["size"], r["n"], r["labels"])
        visits = _visits_for(own, grid, r["size"], r["n"], threshold, recall)
        placed = placed.unionByName(_placed(own, grid, r["size"], visits))
    return stored(placed, "vector-cells")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``vectors``.

    Copies (same label and embedding) become one class first, counted on the map side; what they add to n_links is
    their number. Each class is at home in its nearest cell of the product grid and visits its nearest cells in
    multi-sequence order; how many is measured against brute force until the target recall is reached. Only
    vectors that meet in a cell of their label are compared, in double precision. Cells with more vectors than a block are cut
    into pairs of blocks, so a crowded cell is many tasks; a task returns one row per vector, never
    its pairs. Vectors of different lengths have no links with each other: every length has a grid of its own, or, with few
    vectors, a single cell. Vectors of one component link by sign. Vectors that cannot be compared (see ``comparable``) have no
    links. Repeated rows are copies; a NULL vec_id counts as larger than all others; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    # all one-component vectors of a sign point the same way: one class
    sign = F.transform("embedding", F.signum).cast(kind)
    usable = comparable(rows).withColumn("embedding", F.when(F.size("embedding") == 1, sign).otherwise(F.col("embedding")))
    known = usable.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    numbered = known.withColumns({"id": F.monotonically_increasing_id(), "size": F.size("embedding")})
    classes = stored(numbered, "vector-classes")
    placed = _placed_by_length(classes, threshold, recall)
    cell = ["label", "size", "cell"]
    homes = placed.groupBy("label", "size", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("h"))
    guests = placed.select("label", "size", F.explode("visits").alias("cell")).groupBy(*cell).agg(F.count(F.lit(1)).alias("v"))
    crowded = homes.join(guests, cell).where((F.col("h") > BLOCK) | (F.col("v") > BLOCK))
    crowded = stored(crowded.select(*cell, F.ceil(F.col("h") / BLOCK).alias("h_parts"), F.ceil(F.col("v") / BLOCK).alias("v_parts")), "crowded-cells")
    crowded = F.broadcast(crowded) if is_small(crowded) else crowded
    columns = ["id", "label", "size", "copies", "home", "embedding"]
    own = placed.select(*columns, "visits", F.col("home").alias("cell"), F.lit(0).alias("role"))
    guest = placed.select(*columns, F.lit(None).cast("array<bigint>").alias("visits"), F.explode("visits").alias("cell"), F.lit(1).alias("role"))
    both = own.unionByName(guest.select(*own.columns)).join(crowded, cell, "left")
    h_parts, v_parts = F.coalesce("h_parts", F.lit(1)), F.coalesce("v_parts", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, h_parts).otherwise(v_parts))
    against = F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, v_parts).otherwise(h_parts) - 1)
    both = both.withColumn("mine", mine).withColumn("against", F.explode(against))
    both = both.withColumn("home_part", F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("against")))
    both = both.withColumn("visit_part", F.when(F.col("role") == 0, F.col("against")).otherwise(F.col("mine")))
    found = stored(_compared(both.drop("mine", "against", "h_parts", "v_parts"), threshold), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    described = placed.select("id", "label", "embedding", "copies", "low").join(links, "id", "left").join(member, "id", "left")
    described = stored(described.withColumn("root", F.coalesce("root", "id")), "vector-members")
    least = described.groupBy("root").agg(F.min("low").alias("component_id"))
    described = described.join(least, "root").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    described = described.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id", F.lit(True).alias("linked"))
    asked = rows.withColumn("direction", F.when(F.size("embedding") == 1, sign).otherwise(F.col("embedding")))
    out = asked.join(described, (asked["label"] == described["l"]) & (asked["direction"] == described["e"]), "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
