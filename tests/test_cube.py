import pytest
from pyspark.sql import functions as F

from crawl_analytics.plans import cube, metrics

DIMS = ["experiment_id", "request_resource_type", "website_continent"]
EXACT = ["total_network_requests", "total_trackers_loaded", "total_seed_domains"]


def summary(spark, rows=4000):
    i = F.col("id")
    return spark.range(rows).select(
        F.when(i % 7 == 0, None).otherwise(F.concat(F.lit("e"), (i % 3).cast("string"))).alias("experiment_id"),
        F.when(i % 3 == 0, "script").otherwise("image").alias("request_resource_type"),
        F.when(i % 11 == 0, None).otherwise(F.concat(F.lit("c"), (i % 4).cast("string"))).alias("website_continent"),
        (i % 5 == 0).alias("request_is_tracker"),
        F.when(i % 13 == 0, None).otherwise(F.concat(F.lit("d"), (i * 17 % 900).cast("string"))).alias("request_requested_domain"),
        F.when(i % 17 == 0, None).otherwise(F.concat(F.lit("s"), (i * 31 % 700).cast("string"))).alias("seed_domain"),
        (i % 4).alias("copies"),
    )


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_every_grouping_equals_the_measures(spark, tmp_path):
    rows = summary(spark)
    view = metrics.site_summary_view(rows)
    stored = cube.build_cube(rows, str(tmp_path / "cube"), DIMS, [["experiment_id"], DIMS[:2]])
    for dims in ([], ["experiment_id"], ["request_resource_type"], DIMS[:2], ["website_continent", "experiment_id"], DIMS):
        plain = rows.groupBy(*dims).agg(view.measures[EXACT[0]].alias("a"), view.measures[EXACT[1]].alias("b"), view.measures[EXACT[2]].alias("c"))
        assert order(stored.query(dims, EXACT).collect()) == order(plain.collect())
        exact = {tuple(r)[:-1]: r.n for r in rows.groupBy(*dims).agg(F.count_distinct("request_requested_domain").alias("n")).collect()}
        for r in stored.query(dims, ["unique_domains_contacted"]).collect():
            assert abs(r.unique_domains_contacted - exact[tuple(r)[:-1]]) <= 0.04 * exact[tuple(r)[:-1]]
    for value in ("e1", None):
        plain = rows.where(F.col("experiment_id").eqNullSafe(F.lit(value))).groupBy("request_resource_type")
        plain = plain.agg(*[view.measures[m].alias(m) for m in EXACT])
        assert order(stored.query(["request_resource_type"], EXACT, {"experiment_id": value}).collect()) == order(plain.collect())


def test_a_query_reads_the_smallest_grouping(spark, tmp_path):
    stored = cube.build_cube(summary(spark, 200), str(tmp_path / "cube"), DIMS, [["experiment_id"], DIMS[:2]])
    assert all("/cells-1/" in f for f in stored.query(["experiment_id"], EXACT[:1]).inputFiles())
    assert all("/cells-2/" in f for f in stored.query(["request_resource_type"], EXACT[:1]).inputFiles())
    with pytest.raises(KeyError):
        stored.query(["seed_domain"], EXACT)
    with pytest.raises(KeyError):
        stored.query(DIMS, ["sites"])
    with pytest.raises(KeyError):
        cube.build_cube(summary(spark, 9), str(tmp_path / "other"), DIMS, [["seed_domain"]])


def test_seed_numbers_have_no_gaps(spark):
    numbers = sorted(r.seed for r in cube.seed_numbers(summary(spark)).collect())
    assert numbers == list(range(len(numbers))) and numbers


def test_empty_table(spark, tmp_path):
    stored = cube.build_cube(summary(spark, 0), str(tmp_path / "cube"), DIMS)
    assert stored.query(["experiment_id"], EXACT).collect() == []
    assert [tuple(r) for r in stored.query([], EXACT).collect()] == [(0, None, 0)]
