import re

import pytest
from cases import DOCUMENTS, no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import licenses

PATTERN = re.compile(licenses.WORD)
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
MIT, BSD = licenses.NOTICES[10][0], licenses.NOTICES[12][0]


def split(text):
    return PATTERN.findall((text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))


def places(text):
    """(n_words, n_base, first, last, base labels) by looking at every word."""
    words, found, labels = split(text), [], set()
    for phrase, label in licenses.PHRASES:
        want = phrase.split(" ")
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        found += at
        labels |= {label} if at else set()
    return len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def similarity(text, notice):
    """The best verified share of a notice in a text, by loops over diagonals."""
    words, want = split(text), split(notice)
    k = min(3, len(want))
    votes = {}
    for i in range(len(words) - k + 1):
        for p in range(len(want) - k + 1):
            if words[i : i + k] == want[p : p + k]:
                votes.setdefault(i - p, set()).add(p)
    best = 0.0
    for d, ps in votes.items():
        near = {e: q for e, q in votes.items() if abs(e - d) <= licenses.NEAR}
        if max((len(q), -e) for e, q in near.items()) != (len(ps), -d):
            continue
        covered = {p + j for q in near.values() for p in q for j in range(k)}
        first, last = min(e + min(q) for e, q in near.items()), max(e + max(q) for e, q in near.items()) + k - 1
        best = max(best, len(covered) / max(len(want), last - first + 1))
    return best if best >= (1.0 if len(want) < licenses.SHORT else licenses.SIMILAR) else 0.0


def brute(doc_id, text):
    base = places(text)
    near = {}
    for notice, label in licenses.NOTICES:
        near[label] = max(near.get(label, 0.0), similarity(text, notice))
    labels = {label for label, s in near.items() if s} | set(filter(None, base[4].split(",")))
    return doc_id, *base, ",".join(sorted(labels)), max([1.0 if base[1] else 0.0, *near.values()])


def scan(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return sorted((tuple(r) for r in licenses.scanned(spark.createDataFrame(rows, DOCUMENTS)).select(COLUMNS).collect()), key=str)


def edited(text, at, put):
    words = text.split(" ")
    return " ".join([*words[:at], *put, *words[at + (0 if put else 1) :]])


def test_notices_with_edits(spark):
    texts = [MIT, edited(MIT, 20, ["plainly"]), edited(MIT, 20, []), edited(edited(MIT, 60, []), 10, ["one", "two"]), MIT.upper() + " " + BSD]
    texts += [" ".join(MIT.split(" ")[:40]), " ".join(MIT.split(" ")[::-1]), "lorem " * 50 + BSD + " ipsum" * 50, MIT + " " + MIT]
    texts += ["cc by cc by cc by-nc 4.0", "This is the Apache  License, MIT\nLicense. apache license", "all rights reserved all rights reserved all", "GNU General Public License", "licensed under the gnu general public license version 3"]
    got = scan(spark, texts)
    assert got == sorted((brute(i, t) for i, t in enumerate(texts)), key=str)
    labels = {r[0]: r[6] for r in got}
    assert labels[0] == labels[1] == labels[2] == labels[3] == "mit-text" and labels[4] == "bsd-text,mit-text"
    assert labels[5] == labels[6] == "" and labels[9] == "cc-by" and labels[13] == "gpl,gpl-3.0"


def test_against_loops_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=str)
    from crawl_analytics.llm import queries

    got = sorted((tuple(r) for r in queries.registry()["op11_licenses"](spark, sf).select(COLUMNS).collect()), key=str)
    assert got == want and any(r[5] for r in got) and sum(not r[6] for r in got) > len(got) / 2


def test_odd_documents(spark):
    odd = odd_documents(spark, ("words", "d", "template", "label", "copies", "ps"))
    want = sorted((brute(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert sorted((tuple(r) for r in licenses.scanned(odd).select(COLUMNS).collect()), key=str) == want
    assert licenses.scanned(no_documents(spark)).count() == 0


def test_hot_document_and_long_text(spark):
    """A text of 20 MB, and a phrase that makes thousands of diagonals in one document."""
    long_text = "word " * 4_000_000 + "MIT license"
    rows = [(1, long_text, None, None, None), (2, "cc by " * 20_000, None, None, None)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert (got[1].n_words, got[1].first_word, got[1].labels) == (4_000_002, 4_000_000, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (20_000, 0, 39_998)


def test_plan_without_python(spark, sf):
    plan = licenses.scanned(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("own", [[("blue moon public grant", "blue")]])
def test_own_templates(spark, own):
    docs = spark.createDataFrame([(1, "a Blue moon public grant b", None, None, None)], DOCUMENTS)
    r = licenses.scanned(docs, licenses.templates(spark, own, [])).where(F.col("n_base") == 1).collect()[0]
    assert (r.first_word, r.labels, r.score) == (1, "blue", 1.0)
