import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from crawl_analytics.llm import simhash

DROPPING = corpus_pipeline.STAGES[:3]


def test_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.ORACLE_SQL is None
    for _, stage in DROPPING:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and 0.7 * docs.count() < len(ids) <= docs.count()
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert groups == docs.count()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).drop("ids").collect()
    assert rows and sorted(r.sequence_id for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_documents(spark, sf, name, stage):
    docs = odd_documents(spark)
    found = stage(spark, docs, sf)
    assert found.count() > 0
    if name != "packing":
        assert found.columns == docs.columns
    assert stage(spark, no_documents(spark), sf).count() == 0


def test_clean_documents_stay(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") > 200)
    clean = docs.join(labels, "doc_id", "left_semi")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, sf)
        assert kept.join(clean, "doc_id", "left_semi").count() >= 0.98 * clean.count()
