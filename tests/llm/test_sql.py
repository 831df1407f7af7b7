"""The queries that SQL can say, against DuckDB."""

import os

import pytest

from crawl_analytics.llm import oracles, queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_query_equals_sql(spark, sf, con, name):
    frame = queries.registry()[name](spark, sf)
    result = con.execute(oracles.oracles()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(map(plain, frame.select(*columns).collect()), key=str) == sorted(map(plain, result.fetchall()), key=str)
