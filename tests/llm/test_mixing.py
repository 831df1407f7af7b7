import re
from collections import defaultdict

import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import mixing, queries


def shared_out(sizes: list[int], most: int = 3) -> list[float]:
    """Targets by the rule as it is told: share by weight, cut what is too much, share that again."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, rest, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while rest > 1e-9 and free:
        whole = sum(weights[i] for i in free)
        for i in free:
            target[i] += rest * weights[i] / whole
        rest = sum(max(0.0, target[i] - most * sizes[i]) for i in free)
        full = {i for i in free if target[i] >= most * sizes[i]}
        for i in full:
            target[i] = most * sizes[i]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000, 5, 5, 7, 0], [0, 0], [100], [1000, 1, 1], [3, 400, 2, 9, 1, 70, 8, 8]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(shared_out(sizes))


def test_position_inverts_the_integral(spark):
    for rank, schedule in enumerate(mixing.SCHEDULES):
        points = [(a / 200,) for a in range(201)]
        got = spark.createDataFrame(points, "s double").select("s", mixing.position(F.col("s"), F.lit(rank)).alias("t")).collect()

        def rate(t, schedule=schedule):
            for (a, ra), (b, rb) in zip(schedule, schedule[1:], strict=False):
                if t <= b:
                    return ra + (rb - ra) * (t - a) / (b - a)

        steps = 20_000
        area = [0.0]
        for i in range(steps):
            area.append(area[-1] + (rate(i / steps) + rate((i + 1) / steps)) / 2 / steps)
        for r in got:
            assert area[round(r.t * steps)] / area[-1] == pytest.approx(r.s, abs=1e-3)


def check(docs, rows):
    source_of = {}
    sizes = defaultdict(int)
    for doc_id, source, text in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        source_of[doc_id, n] = source
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, shared_out([sizes[n] for n in names]), strict=True))
    taken = defaultdict(int)
    for r in rows:
        source = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] and len(r.positions) * r["size"] == r.taken
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[source] += r.taken
    largest = defaultdict(int)
    for r in rows:
        largest[source_of[r.doc_id, r["size"]]] = max(largest[source_of[r.doc_id, r["size"]]], r["size"])
    for source in names:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1
    return taken, target


def test_query(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    found = mixing.mixture(documents)
    rows = found.collect()
    assert len(rows) == documents.count()
    check([(r.doc_id, r.source, r.text) for r in documents.collect()], rows)
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    again = queries.registry()["op2_mixing"](spark, sf)
    assert again.columns == columns
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, again.collect()))
    for name in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"):
        assert name not in found._jdf.queryExecution().executedPlan().toString()


def test_odd_documents(spark):
    docs = odd_documents(spark, ("size", "h", "copies", "mix_positions"))
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    by_row = {}
    for r in rows:  # repeated rows are taken equally often
        assert by_row.setdefault((r.doc_id, r["size"], r.source_size), r.taken) == r.taken
    assert mixing.mixture(no_documents(spark)).count() == 0


def test_mixed_rows_are_the_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("mix_position", F.lit(1))
    got = {r.doc_id: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mixture(docs).where("taken > 0").collect()}
    assert got == want
    assert mixing.mixed(docs).columns == docs.columns
