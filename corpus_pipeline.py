"""The corpus pipeline: filter by language and quality, deduplicate, mix and pack documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawl_analytics.llm import langid, mixing, packing, quality, simhash
from crawl_analytics.llm.common import stored, table
from crawl_analytics.session import use_utc


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernel tells; texts without a letter go."""
    return langid.identified(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash of three-word shingles, at most two bits apart): that with the smallest id."""
    return simhash.one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mixture takes, in training order; documents it does not take go."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length with their ids, one sequence each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

# The tokenizer and the trained classifiers are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage reads what its predecessor wrote."""
    use_utc(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
