import hashlib
import re

import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import merkle, queries


def leaves(text):
    return re.findall(r"[^\n]{1,64}\n?|\n", text)


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = set(leaves(a)), set(leaves(b))
    return min(2 * len(x & y) / (len(x) + len(y)), 0.999999) if x or y else 0.0


def edited(text, following):
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def check(docs, rows):
    by_id = {}
    for doc_id, text in docs:
        if doc_id is not None:
            by_id[doc_id] = min(text or "", by_id.get(doc_id, text or ""), key=lambda t: t.encode())
    ids = sorted(by_id)
    after = {a: by_id[b] for a, b in zip(ids, ids[1:] + ids[:1], strict=True)} if ids else {}
    want = []
    for doc_id, text in docs:
        text = text or ""
        following = after[doc_id] if doc_id is not None else ""
        new = edited(text, following)
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), round(likeness(text, new), 9), round(likeness(text, following), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    text_of = {}
    for r in rows:
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
        text_of.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert all(len(sizes) == 1 for sizes in text_of.values())


def test_query(spark, sf):
    found = queries.registry()["op5_fingerprints"](spark, sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(docs, found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("EvalPython", "MapIn", "CartesianProduct", "NestedLoop"))


def test_odd_documents(spark):
    docs = odd_documents(spark, ("node", "head", "next", "n"))
    check([(r.doc_id, r.text) for r in docs.collect()], merkle.compared_with_edit(docs).collect())
    assert merkle.compared_with_edit(no_documents(spark)).count() == 0


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(7, "abcd" * 40)], "doc_id long, text string")
    row = merkle.compared_with_edit(docs).first()
    assert row.near_next == 1.0 and row.near_edited == 1.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_successors_over_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 100 // ranges)
    ids = [3 * i - 50 for i in range(100)]
    got = {r.id: r.before for r in merkle.successors(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id").collect()}
    assert got == {b: a for a, b in zip([ids[-1], *ids[:-1]], ids, strict=True)}


def test_branches_locate_the_edit(spark):
    lines = [f"line {i} of the text\n" for i in range(200)]
    other = lines.copy()
    other[70] = "something else\n"
    rows = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    found = rows.select(merkle.edited_sections(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("s"), merkle.edited_sections(merkle.tree(F.col("a")), merkle.tree(F.col("a"))).alias("none")).first()
    assert found.s == [70 // merkle.SECTION_BLOCKS] and found.none == []
