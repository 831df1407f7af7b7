import zlib
from collections import Counter

import numpy as np
import pytest
from cases import ODD_TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import packing, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary()[0])
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    encode = packing.Encoder(*packing.vocabulary())
    for text in ODD_TEXTS:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == library(text)


def test_binary_lengths():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        lengths = packing.binary_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1024 for x in lengths)
        assert lengths == sorted(lengths, reverse=True)


def check(docs, rows, library):
    """Every piece against the library's ids, every sequence one piece, ids gapless and lengths in ranges of them."""
    want = Counter()
    for doc_id, text in docs:
        ids = [*library(text), 0]
        start = 0
        for length in packing.binary_lengths(len(ids)):
            raw = np.array(ids[start : start + length], "<u4").tobytes()
            want[doc_id, start, length, zlib.crc32(raw), len(ids)] += 1
            start += length
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 for r in rows)
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)


def test_query_against_the_library(spark, sf, library):
    rows = queries.registry()["op1_packing"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(docs, rows, library)


def test_odd_documents(spark, library):
    docs = odd_documents(spark, ("length", "part", "ids", "place"))
    rows = packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows, library)
    assert packing.pack(no_documents(spark)).count() == 0


def test_the_join_beyond_the_lookup_limit(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "is_small", lambda rows: False)
    docs = odd_documents(spark)
    rows = packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows, library)
