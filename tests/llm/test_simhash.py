import re
from itertools import combinations

import numpy as np
import xxhash
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import components, queries, simhash
from crawl_analytics.llm.common import stored


def fingerprint(text) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_of(docs) -> dict:
    """{(doc_id, fingerprint): component_id} by comparing all pairs of different fingerprints."""
    marks = [(doc_id, fingerprint(text)) for doc_id, text in docs]
    root = {f: f for _, f in marks}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for doc_id, f in marks:
        if doc_id is not None:
            least[find(f)] = min(doc_id, least.get(find(f), doc_id))
    return [(doc_id, f"{f:016x}", least.get(find(f))) for doc_id, f in marks]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert order(queries.registry()["op3_simhash"](spark, sf).collect()) == order(components_of(docs))


def test_odd_documents(spark):
    docs = odd_documents(spark, ("fp", "fingerprint", "component_id"))
    assert order(simhash.near_duplicates(docs).collect()) == order(components_of([(r.doc_id, r.text) for r in docs.collect()]))
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_anchors_meet_all_pairs(spark):
    """Chains of fingerprints one or two bits apart, in any half, against all pairs."""
    random = np.random.default_rng(7)
    marks = set()
    for _ in range(60):
        at = int(random.integers(0, 1 << 63))
        for _ in range(12):
            marks.add(at)
            for bit in random.integers(0, 64, int(random.integers(1, 4))):
                at ^= 1 << int(bit)
    marks |= {0, (1 << 64) - 1, 1 << 31, 1 << 63, 3}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).distinct().collect()
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert {tuple(r) for r in found} == want


def test_visits_are_not_broadcast(spark):
    """The stored fingerprints are a small table, their visits are not, and Spark sizes these by the table."""
    marks = spark.range(500).select(F.explode(F.array(F.xxhash64("id"), F.xxhash64("id").bitwiseXOR(F.lit(5)))).alias("fp"))
    links = simhash.near_links(stored(marks, "marks"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert links.distinct().count() == 500


def test_documents_are_not_broadcast(spark):
    """The last join: documents and their fingerprints compress well and would be taken for a small table."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"))
    found = simhash.near_duplicates(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\w+Join", plan)[0] == "SortMergeJoin"
    assert order(found.collect()) == order(components_of([(r.doc_id, r.text) for r in docs.collect()]))


def test_one_per_group(spark):
    docs = odd_documents(spark, ("fp", "copy_number"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    groups = {c for _, _, c in components_of(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_one_of_planted_copies(spark):
    """Exact copies, near copies, repeated rows and rows without an id, against all pairs; a column named like the function's own."""
    random = np.random.default_rng(5)
    rows = []
    for group in range(30):
        words = [f"w{random.integers(9000)}" for _ in range(1500)]
        rows += [(len(rows) + k, " ".join(words[: 1500 - k] + ["last"] * k)) for k in range(3)]
        rows += [(None, " ".join(words))] * (group % 3) + [(rows[-1])]
    rows += [(None, "alone without an id")] * 500 + [(0, "another text under the first id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = docs.withColumn("__row", F.lit(1)).withColumn("h", F.create_map(F.lit("k"), F.lit("v")))
    kept = simhash.one_per_group(docs)
    assert kept.dtypes == docs.dtypes
    groups = {c for _, _, c in components_of(rows)}
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(groups) < 100 and all(r in rows for r in found)
    # two components may have the same smallest id here: both keep a row
    marks = {(c, f) for _, f, c in components_of(rows)}
    assert {d for d, _ in found} == groups and len(found) == len(set(found)) <= len(marks)
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    random = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
