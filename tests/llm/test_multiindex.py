import os

import numpy as np
import pytest

from crawl_analytics.llm import multiindex, queries


def brute(rows):
    """{row number: (links, component)} by all pairs of a label."""
    usable = []
    for i, (_, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None for x in v):
            continue
        v = np.array(v, dtype=np.float32).astype(np.float64)
        if np.isfinite(v).all() and v.any():
            usable.append((i, (label, len(v)), v / np.sqrt((v * v).sum())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for label in {u[1] for u in usable}:
        mine = [u for u in usable if u[1] == label]
        near = np.array([u[2] for u in mine]) @ np.array([u[2] for u in mine]).T >= 0.93
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            links[mine[a][0]] += 1
            links[mine[b][0]] += 1
            root[find(mine[a][0])] = find(mine[b][0])
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return [(rows[i][0], links[i], least.get(find(i))) for i in range(len(rows))]


def recall(got, want):
    got = {r.vec_id: r.n_links for r in got}
    assert all(got[i] <= n for i, n, _ in want)
    links = sum(n for _, n, _ in want)
    return sum(got.values()) / links if links else 1.0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1", "check_s"])
def test_recall_against_all_pairs(spark, folder):
    sf = f"/root/testdata/{folder}"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.registry()["op7_embeddings"](spark, sf).collect()
    want = brute(rows)
    assert len(got) == len(rows) and recall(got, want) >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    exact = {i: (n, c) for i, n, c in want}
    same = sum((r.n_links, r.component_id) == exact[r.vec_id] for r in got)
    assert same >= 0.97 * len(rows)


def crowd(seed=1, copies=40, near=150, noise=60, size=16):
    random = np.random.default_rng(seed)
    center = random.normal(size=size)
    rows = [center] * copies + [center + 0.08 * random.normal(size=size) for _ in range(near)] + list(random.normal(size=(noise, size)))
    return [(i, int(i % 7 == 0), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 16])
def test_crowded_cells_in_block_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    rows = crowd()
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = multiindex.near_duplicates(frame, recall=1.0).collect()
    want = brute(rows)
    assert recall(got, want) >= 0.99
    exact = {i: c for i, _, c in want}
    assert sum(r.component_id == exact[r.vec_id] for r in got) >= 0.98 * len(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 1.0, 1.0]]
    rows = [(i, 1, v) for i, v in enumerate(odd)] + [(10, None, [1.0, 2.0]), (11, 2, [1.0, 2.0]), (12, 2, [2.0, 4.0]), (12, 2, [2.0, 4.0]), (None, 2, [1.0, 2.0]), (14, 1, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, id string")
    got = sorted((tuple(r) for r in multiindex.near_duplicates(frame).collect()), key=str)
    want = [(i, 0, i, True) for i in [*range(7), 10, 14]] + [(11, 3, 11, True), (12, 3, 11, False), (12, 3, 11, False), (None, 3, 11, False)]
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert multiindex.near_duplicates(empty).count() == 0
    assert multiindex.near_duplicates(frame.where("label is null")).collect()[0].n_links == 0


@pytest.mark.parametrize("grid_rows", [20, 256])
def test_several_lengths_in_one_label(spark, monkeypatch, grid_rows):
    """Every length has its links: frequent ones through a grid, rare ones in a cell, single components by their sign."""
    monkeypatch.setattr(multiindex, "GRID_ROWS", grid_rows)
    random, rows = np.random.default_rng(8), []
    for size, n in ((1, 40), (2, 60), (3, 30), (8, 90), (16, 5), (17, 2)):
        vectors = random.normal(size=(n, size))
        vectors[: n // 2] = vectors[n - n // 2 :] + 0.05 * random.normal(size=(n // 2, size))
        rows += [(len(rows) + i, int(i % 5 == 0), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, 1, [1.0, 2.0, 4.0]) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_duplicates(frame, recall=1.0).collect())
    want = sorted(brute(rows))
    if grid_rows == 256:
        assert got == want
    same = sum(a == b for a, b in zip(got, want, strict=True))
    assert same >= 0.95 * len(rows) and [g for g in got if g[0] < 40] == [w for w in want if w[0] < 40]


def test_one_component_only(spark):
    rows = [(i, 1, [float(x)]) for i, x in enumerate([1, 2, -3, -0.5, 0, 7e-30])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_duplicates(frame).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4), (5, 2, 0)]


def test_visits_are_the_nearest_cells():
    random = np.random.default_rng(0)
    grid = multiindex.Grid(random.normal(size=(7, 3)), random.normal(size=(5, 3)))
    vectors = random.normal(size=(50, 6))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    cost = ((unit[:, None, :3] - grid.books[0]) ** 2).sum(-1)[:, :, None] + ((unit[:, None, 3:] - grid.books[1]) ** 2).sum(-1)[:, None, :]
    for most in (1, 4, 35):
        assert (grid.visits(vectors, most) == np.argsort(cost.reshape(50, -1), axis=1)[:, :most]).all()


def rare_links(spark, rows=4000, pairs=8, size=16):
    """(classes, grid) of random vectors of one label, few of them linked, in a grid much finer than four visits cover."""
    random = np.random.default_rng(4)
    vectors = random.normal(size=(rows, size))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[:pairs] = 0.94 * vectors[pairs : 2 * pairs] + 0.34 * vectors[:pairs]
    frame = spark.createDataFrame([(i, i, 1, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, low long, label long, embedding array<double>")
    half = size // 2
    return frame, multiindex.Grid(multiindex._k_means(vectors[:, :half], 24), multiindex._k_means(vectors[:, half:], 24))


def test_visits_without_links_in_the_sample(spark, monkeypatch):
    """Queries that see no link do not end at four visits: links at the threshold are found at the recall asked for."""
    monkeypatch.setattr(multiindex, "QUERIES", 256)
    monkeypatch.setattr(multiindex, "MOST_QUERIES", 256, raising=False)
    frame, grid = rare_links(spark, pairs=0)
    visits = multiindex._visits_for(frame, grid, 16, 4000, 0.93, 0.99)
    random = np.random.default_rng(9)
    a, side = random.normal(size=(2, 2000, 16))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * side / np.linalg.norm(side, axis=1)[:, None]
    to_b, to_a = grid.visits(a, visits), grid.visits(b, visits)
    found = (to_b == to_a[:, :1]).any(axis=1) | (to_a == to_b[:, :1]).any(axis=1)
    assert visits > 4 and found.mean() >= 0.97


def test_visits_grow_beyond_the_first_most(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "MOST_VISITS", 2)
    frame, grid = rare_links(spark, pairs=300)
    assert multiindex._visits_for(frame, grid, 16, 4000, 0.93, 0.99) > 2
