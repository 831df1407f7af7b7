import random

from pyspark.sql import functions as F

from crawl_analytics.operators import enrich
from crawl_analytics.operators import joins
from crawl_analytics.operators.joins import first_rows, hot_buckets, is_small, repeat_rows, salted_join
from crawl_analytics.operators.ranking import running_number
from crawl_analytics.schemas import CONSENTS, REQUESTS, RESPONSES, SITE_METADATA, WORKER_METADATA, conform

COLUMNS = "experiment_id string, crawled_url string, crawl_session_id string, url string"


def requests(spark, rows):
    return conform(spark.createDataFrame(rows, COLUMNS), REQUESTS)


def site_rows(spark):
    seed = "https://example.com"
    return requests(spark, [("e", seed, "s1", "a.js"), ("e", seed, "s1", "b.js"), ("e", seed, "s2", "c.js")])


def test_session_with_most_requests_is_kept(spark):
    rows = enrich.dedup_requests(site_rows(spark)).collect()
    assert {(r.crawl_session_id, r.url) for r in rows} == {("s1", "a.js"), ("s1", "b.js")}


def test_equal_counts_keep_the_smaller_session(spark):
    rows = requests(spark, [("e", "u", "s2", "a"), ("e", "u", "s1", "b"), ("f", "u", "s9", "c")])
    kept = {(r.experiment_id, r.keep_session) for r in enrich.kept_sessions(rows).collect()}
    assert kept == {("e", "s1"), ("f", "s9")}


def test_site_metadata_follows_the_kept_session(spark):
    rows = [("e", "s1", "1", "weather for today"), ("e", "s2", "2", "recipes")]
    sites = spark.createDataFrame(rows, "experiment_id string, crawl_session_id string, timestamp string, description string")
    out = enrich.dedup_site_metadata(sites, enrich.kept_sessions(site_rows(spark))).collect()
    assert [(r.crawl_session_id, r.description) for r in out] == [("s1", "weather for today")]


def test_repeats_keep_the_earliest_row(spark):
    rows = [("e", "u", "s", "a", "5", "r2"), ("e", "u", "s", "a", "5", "r1"), ("e", "u", "s", "a", "7", "r0")]
    frame = spark.createDataFrame(rows, COLUMNS + ", timestamp string, request_id string")
    assert [r.request_id for r in enrich.dedup_requests(frame).collect()] == ["r1"]


def test_one_consent_per_seed_and_latest_worker(spark):
    kept = enrich.kept_sessions(site_rows(spark))
    seed = "https://example.com"
    consents = spark.createDataFrame(
        [("e", "s1", seed, "p", "2"), ("e", "s1", seed, "q", "1"), ("e", "s2", seed, "r", "0")],
        "experiment_id string, crawl_session_id string, crawled_url string, url string, timestamp string",
    )
    assert [r.url for r in enrich.dedup_consents(conform(consents, CONSENTS), kept).collect()] == ["q"]
    workers = spark.createDataFrame(
        [(e, "w", c, True, t) for e in "abc" for c, t in (("XX", 1.0), ("DE", 2.0))], WORKER_METADATA
    )
    assert {(r.experiment_id, r.country_code) for r in enrich.dedup_workers(workers).collect()} == {(e, "DE") for e in "abc"}
    assert [r.country_code for r in enrich.dedup_workers(workers, strict=True).collect()] == ["DE"]


def test_responses_of_sessions_without_requests_vanish(spark):
    rows = spark.createDataFrame([("e", "https://example.com", "s1", "a"), ("e", "other", "s7", "b")], COLUMNS)
    out = enrich.dedup_responses(conform(rows, RESPONSES), enrich.kept_sessions(site_rows(spark)))
    assert [r.url for r in out.collect()] == ["a"]


def test_empty_inputs_give_empty_outputs(spark):
    none = spark.createDataFrame([], REQUESTS)
    assert enrich.dedup_requests(none).count() == 0
    assert enrich.dedup_site_metadata(spark.createDataFrame([], SITE_METADATA), enrich.kept_sessions(none)).count() == 0


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    facts = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        F.col("id").alias("v"),
    )
    dim = spark.range(150).select(
        F.when(F.col("id") < 3, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("d")
    )
    assert len(hot_buckets(facts, [["k"], ["v"]], 10)[0]) >= 1
    assert hot_buckets(facts, [["k"], ["v"]], 10)[1] == {}
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, facts.join(dim, ["k"], how).collect()))
        salted = sorted(map(str, salted_join(facts, dim, ["k"], how, min_rows=10).collect()))
        assert salted == plain, how


def test_hot_buckets_count_weights(spark):
    rows = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 1)], "k string, n bigint")
    assert len(hot_buckets(rows, [["k"]], 10, weight="n")[0]) == 1


def test_lookup_is_measured(spark):
    assert is_small(spark.range(10).selectExpr("cast(id as string) k"), 10, 1000)
    assert not is_small(spark.range(11).selectExpr("cast(id as string) k"), 10, 1000)
    assert not is_small(spark.range(10).selectExpr("repeat('x', 200) k"), 10, 1000)


def test_repeat_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 9000), ("c", 4096)], "k string, n bigint")
    counts = {r.k: r["count"] for r in repeat_rows(rows, "n").groupBy("k").count().collect()}
    assert counts == {"a": 1, "b": 9000, "c": 4096}


def test_first_rows_settles_ties_by_content(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a")], "k string, t int, v string")
    assert [tuple(r) for r in first_rows(rows, ["k"], ["t"]).collect()] == [("k", 1, "a")]


def test_running_number_equals_sorting_with_a_hot_value(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "big" if rng.random() < 0.7 else f"g{rng.randrange(3)}"
        rows.append((group, 500 if rng.random() < 0.4 else rng.randrange(1000), f"s{i}"))
    frame = spark.createDataFrame(rows, "g string, t bigint, s string")
    got = running_number(frame, ["g"], "t", ["s"], "n", ties=4, cuts=16).collect()
    for group in {r[0] for r in rows}:
        mine = sorted((r.n, r.t) for r in got if r.g == group)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [t for _, t in mine] == sorted(t for g, t, _ in rows if g == group)


def test_parts_follow_from_size_not_from_share(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASKS", 1000)
    rows = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    (hot,) = hot_buckets(rows, [["k"]], min_rows=1)
    assert list(hot.values()) in ([10], [11])  # one percent of the rows is ten tasks' share, and neighbours in the bucket


def test_a_ranked_list_of_a_million_is_a_lookup(spark):
    assert is_small(spark.range(1_000_000).selectExpr("concat('site', id, '.example') domain", "id rank"))


def test_rows_are_sorted_by_a_hash_first(spark):
    """Keys that begin alike, NULL, NaN and both zeros: the same rows, but sorts that tell keys by their first eight bytes."""
    nan = float("nan")
    data = [("https://a.example/x", 0.0, 3, "p"), ("https://a.example/x", -0.0, 2, "q"), ("https://a.example/y", nan, 5, "r"), (None, nan, 4, "s"), (None, nan, 1, "t")]
    rows = spark.createDataFrame(data, "url string, part double, n int, who string")
    least, most = first_rows(rows, ["url", "part"], ["n"]), joins.latest_rows(rows, ["url", "part"], ["n"])
    assert sorted(r.who for r in least.collect()) == ["q", "r", "t"] and sorted(r.who for r in most.collect()) == ["p", "r", "s"]
    assert least.columns == rows.columns == most.columns
    dim = spark.createDataFrame([("https://a.example/x", 0.0, 1), (None, nan, 2)], "url string, part double, found int")
    joined = salted_join(rows, dim.hint("merge"), ["url", "part"], "left", hot={})
    assert sorted((r.who, r.found) for r in joined.collect()) == [("p", 1), ("q", 1), ("r", None), ("s", None), ("t", None)]
    assert joined.columns == [*rows.columns, "found"]
    kept = enrich.kept_sessions(site_rows(spark))
    for frame in (least, most, joined, kept):
        sorts = [line.split("Sort [")[1] for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
        assert sorts and all(line.startswith(("__hash", "_groupingexpression")) for line in sorts), sorts


def test_rows_without_a_time_come_last(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "5", 2), ("b", None, 3)], "k string, timestamp string, v int")
    assert {(r.k, r.v) for r in first_rows(rows, ["k"], ["timestamp"]).collect()} == {("a", 2), ("b", 3)}
