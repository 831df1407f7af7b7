from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from crawl_analytics.llm import quality, queries


def test_held_out_accuracy(spark):
    """Learn from the labels of three quarters of the documents, test on the others'."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, labels.where(~held))
    found = docs.withColumn("s", quality.scored(model)).join(labels.where(held), "doc_id").collect()
    good = [r for r in found if r.quality == 1]
    poor = [r for r in found if r.quality == 0]
    assert sum(r.s.score >= quality.KEEP_FROM for r in good) >= 0.98 * len(good)
    assert sum(r.s.score < quality.KEEP_FROM for r in poor) >= 0.7 * len(poor)


def test_query(spark, sf):
    found = queries.registry()["op6_quality"](spark, sf)
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= quality.KEEP_FROM) for r in rows)
    assert sorted(rows) == sorted(queries.registry()["op6_quality"](spark, sf).collect())


def test_odd_documents(spark):
    docs = odd_documents(spark, ("s", "quality", "pick", "label", "quality_score"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] * 2 + [(1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.qualities(docs, labels).count() == docs.count()
    assert quality.good(docs, labels).columns == docs.columns
    assert quality.qualities(no_documents(spark), labels).count() == 0
    rows = quality.qualities(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in rows} == {0.5} and all(r.kept for r in rows)


def test_one_round_of_the_exchange(spark, sf):
    """What each view hands over is what scoring all unlabelled documents one by one says."""
    import numpy as np

    docs = quality._clean(spark.read.parquet(f"{sf}/documents.parquet")).unionByName(quality._clean(spark.read.parquet(f"{sf}/documents.parquet")).where("doc_id < 9"))
    random = np.random.default_rng(3)
    views = [(random.normal(size=n) * 3, 0.1, 1.5, -0.2) for n in (quality.TEXT_BUCKETS, quality.PAGE_BUCKETS)]
    taken = [{1, 2, 3}, {4, 5}]
    want = []
    for view, (w, b, slope, offset) in enumerate(views):
        trusts = {}
        for r in docs.collect():
            features = quality._views([r.text], [r.source], [r.lang], [r.n_chars])[view].astype(np.float16).astype(float)
            trusts[r.doc_id] = float(quality._sigmoid(slope * (features @ w + b) + offset)[0])
        for good in (1, 0):
            sure = [(-(t if good else 1 - t), i) for i, t in trusts.items() if (t if good else 1 - t) >= quality.SURE and i not in taken[1 - view]]
            want += [(view, good, i) for _, i in sorted(sure)[:7]]
    assert len(want) > 10
    assert quality._handed_over(docs.repartition(5), views, taken, 7) == sorted(want)
