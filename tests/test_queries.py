"""Every registered query against its SQL, on the smallest tables."""

import datetime
import os

import pytest

import __spark_entry__ as contract
from crawl_analytics.operators import joins, labelling
from crawl_analytics.oracles import oracles
from crawl_analytics.queries import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WITHOUT_SQL = {"choose_link", "walk", "metrics_approx_domains"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(lines, key=lambda r: [(v is None, str(v)) for v in r])


def test_all_but_three_have_sql():
    assert set(registry()) - set(oracles()) == WITHOUT_SQL
    assert set(registry()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry()))
def test_query_equals_sql(spark, con, name):
    frame = contract.queries()[name](spark, SF)
    mine = table(frame.columns, frame.collect())
    spark.catalog.clearCache()
    if name in WITHOUT_SQL:
        assert mine[1]
        return
    result = con.execute(contract.oracle_sql()[name])
    assert mine == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert {r.category for r in contract.entry(spark).collect()} >= {"Loaded"}


def test_no_plan_multiplies_rows_without_a_key(spark):
    for name in ("crawl_outcomes", "hop_agreement", "experiment_overview", "cookie_warnings"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["dedup_responses", "labeled_requests", "site_summary_strict", "site_summary_enriched"])
def test_results_hold_with_hot_keys_and_large_lookups(spark, con, monkeypatch, name):
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    monkeypatch.setattr(joins, "TASKS", 64)
    monkeypatch.setattr(joins, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(labelling, "LOOKUP_ROWS", 0)
    frame = contract.queries()[name](spark, SF)
    assert "__salt" in frame._jdf.queryExecution().analyzed().toString()
    mine = table(frame.columns, frame.collect())
    spark.catalog.clearCache()
    result = con.execute(contract.oracle_sql()[name])
    assert mine == table([d[0] for d in result.description], result.fetchall())
