import numpy as np
import pytest
from pyspark.sql import functions as F

from crawl_analytics.llm import negatives, queries

KINDS = "vec_id long, label int, embedding array<float>"


def brute(rows, every=50, positives=5, wanted=3):
    """All rows of the result by plain loops over (vec_id, label, vector)."""
    use = []
    for number, (i, label, v) in enumerate(rows):
        if label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((number, i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    late = lambda i: (i is None, i or 0)
    out = []
    for number, i, label, q in use:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, other, strict=True)), late(j), n, j, k) for n, j, k, other in use if n != number and len(other) == len(q)]
        scored.sort()
        for p in [s for s in scored if s[4] == label][:positives]:
            near = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(i, p[3], rank + 1, s[3], -p[0], -s[0]) for rank, s in enumerate(near[:wanted])]
    return out


def mine(frame, every=50):
    return [tuple(r) for r in negatives.mined(negatives.whole_numbers(frame), F.col("vec_id") % every == 0).collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def crowd(n, size, seed=0, spread=0.6, labels=4):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(labels, size)) + 0.8
    return [(i, i % labels, [float(np.float32(x)) for x in centers[i % labels] * 0.3 + spread * random.normal(size=size) * 0.3]) for i in range(n)]


@pytest.mark.parametrize("size,block", [(1, 1024), (3, 16), (20, 16), (64, 40)])
def test_against_all_pairs(spark, monkeypatch, size, block):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", block)
    rows = crowd(400, size)
    want = brute(rows, every=10)
    same(mine(spark.createDataFrame(rows, KINDS).repartition(3), every=10), want)
    assert len(want) > 100


def test_registered_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same([tuple(r) for r in queries.registry()["op12_negatives"](spark, sf).collect()], brute(rows))


def test_bounds_hold_and_tighten():
    random = np.random.default_rng(1)
    q = random.integers(-300, 300, (50, 37)).astype(float) + 100
    means, deviations = negatives._summaries(q)
    level = np.array([k for k, _, _ in negatives._segments(37)])
    exact, width = q @ q.T, []
    for k in range(len(negatives.LEVELS)):
        middle, spread = means[:, level == k] @ means[:, level == k].T, deviations[:, level == k] @ deviations[:, level == k].T
        assert (middle - spread - 1 <= exact).all() and (exact <= middle + spread + 1).all()
        width.append(spread.mean())
    assert width == sorted(width, reverse=True)


def test_bounds_leave_out_rows(monkeypatch):
    """Far rows are settled by their segments' summaries: exact scores are computed for few."""
    import pyarrow as pa

    random = np.random.default_rng(2)
    q = (np.repeat(random.integers(-200, 200, (500, 4)), 16, axis=1) + random.integers(-5, 5, (500, 64))).astype(np.int32)
    means, deviations = negatives._summaries(q.astype(float))
    rows = pa.table({"rid": range(500), "vec_id": range(500), "label": [1] * 500, "size": [64] * 500, "q": list(q), "means": list(means), "deviations": list(deviations)})
    asked, plain = [], negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda a, s, r, at: (asked.append(len(at)), plain(a, s, r, at))[1])
    monkeypatch.setattr(negatives, "AT_ONCE", 1)
    found = list(negatives._best_of_label(negatives.Block(rows.slice(0, 20)), negatives.Block(rows), 5))
    assert len(found) == 20 and sum(asked) < 0.1 * 20 * 500


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", 4)
    nan, inf = float("nan"), float("inf")
    rows = crowd(60, 6, seed=5, labels=3)
    rows += [(0, 0, rows[0][2])] * 2 + [(50, 1, [1.0] * 6), (None, 0, rows[3][2]), (None, None, rows[3][2]), (100, None, rows[4][2])]
    rows += [(150, 0, v) for v in (None, [], [nan] * 6, [inf] * 6, [None, 1.0])] + [(200, 0, [0.0] * 6), (250, 2, [-1.0] * 6)]
    rows += [(300, 0, [1.0, 2.0]), (301, 0, [1.0, 1.5]), (302, 1, [0.9, 1.2]), (303, 1, [0.5, 1.2])] + [(7, 2, rows[7][2])] * 3
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], KINDS + ", rid string, size int")
    want = brute(rows)
    same(mine(frame), want)
    assert any(r[0] == 300 for r in want) and sum(r[0] == 0 for r in want) > 15
    assert mine(frame.where("label is null")) == [] and mine(spark.createDataFrame([], KINDS)) == []


def test_scores_beyond_doubles(spark):
    """Sums above 2^53 are taken in integers; vectors whose scores no long holds a hundred times take no part."""
    random = np.random.default_rng(7)
    rows = [(i, i % 2, [float(np.float32(x)) for x in 3e5 * (1 + 0.3 * random.random(5))]) for i in range(40)]
    same(mine(spark.createDataFrame(rows, KINDS), every=10), brute(rows, every=10))
    assert max(r[4] for r in brute(rows, every=10)) > 1 << 53
    rows.append((50, 0, [2e6] * 5))
    same(mine(spark.createDataFrame(rows, KINDS), every=10), brute(rows[:-1], every=10))
