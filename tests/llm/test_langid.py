from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.registry()["op4_language"](spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = [r for r in found.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert len(rows) >= 0.95 * docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = langid.held_out("doc_id", *langid.HELD_OUT)
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(langid.languages(docs).collect()) == sorted(langid.languages(changed).collect())


def test_kernel_is_the_shared_grams():
    """The batched product against sets, one pair at a time."""
    import numpy as np

    grams = langid.Grams()
    texts = ["Der Hund läuft.", "the dog runs", "Hund und dog", "abc"]
    sets = [grams(t) for t in texts]

    def plain(text):
        c = "".join(ch if ch.isalpha() else " " for ch in text.lower())
        while "  " in c:
            c = c.replace("  ", " ")
        return {c[i : i + n] for n in range(1, 5) for i in range(len(c) - n + 1)}

    spread = np.zeros((langid.BUCKETS, len(sets)))
    for k, s in enumerate(sets):
        spread[s, k] = 1 / np.sqrt(len(s))
    kernel = langid._rows_times(spread, sets)
    for i, a in enumerate(texts):
        assert len(sets[i]) == len(plain(a))
        for j, b in enumerate(texts):
            x, y = plain(a), plain(b)
            assert abs(kernel[i, j] - len(x & y) / (len(x) * len(y)) ** 0.5) < 1e-9


def test_odd_documents(spark):
    docs = odd_documents(spark, ("p", "predicted_language", "score"))
    rows = langid.languages(docs).collect()
    assert len(rows) == docs.count()
    assert langid.languages(no_documents(spark)).count() == 0
    by_text = docs.select("text", langid.predicted(langid.fit(docs)).alias("p")).collect()
    for r in by_text:
        assert (r.p.lang == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.fit(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.identified(docs, 0.0)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


def test_without_languages_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.identified(docs).collect()) == [1, 4]
