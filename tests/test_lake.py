import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawl_analytics.operators import status, tasks, workers
from crawl_analytics.plans.enrichment import enrich
from crawl_analytics.schemas import BY_DATA_TYPE, PARAMS, REQUESTS, RESPONSES, SITE_METADATA, columns, conform
from crawl_analytics.sources import lake, lists


def document(folder, name, **changes):
    path = folder / f"experiment={name}"
    path.mkdir(parents=True, exist_ok=True)
    doc = {"id": name, "timestamp": "2024-01-01T00:00:00", "total_urls": 5, "params": {"browser_type": "firefox"}, **changes}
    (path / "metadata.json").write_text(json.dumps(doc, indent=2))


def test_metadata_skips_what_cannot_be_read(spark, tmp_path):
    document(tmp_path, "exp1")
    document(tmp_path, "exp2", total_urls="many")
    document(tmp_path, "exp3", params=None)
    document(tmp_path, "exp4", params={"browser_type": "lynx"})
    document(tmp_path, "exp5", timestamp="never")
    (tmp_path / "experiment=exp6").mkdir()
    (tmp_path / "experiment=exp6" / "metadata.json").write_text("{ not json")
    (tmp_path / "experiment=exp7").mkdir()
    row = lake.read_metadata(spark, str(tmp_path)).collect()
    assert [r.exp_id for r in row] == ["exp1"]
    assert (row[0].timestamp, row[0].total_urls) == (datetime(2024, 1, 1), 5)
    assert row[0].params.asDict() == {**tasks.PARAM_DEFAULTS, "browser_type": "firefox"}


def test_no_metadata_at_all(spark, tmp_path):
    assert lake.read_metadata(spark, str(tmp_path)).count() == 0


def test_experiment_listing(spark, tmp_path):
    keys = ["experiment=exp1/metadata.json", "experiment=exp2/metadata.json", "notes/plan.md", "experiment=exp3/x.parquet"]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    assert [r.id for r in lake.list_experiments(frame).collect()] == ["exp2", "exp1"]
    document(tmp_path, "one")
    lake.write_metadata(
        spark.createDataFrame([("two", datetime(2024, 1, 1), 1, None)], f"id string, timestamp timestamp, total_urls bigint, params {PARAMS}"), str(tmp_path)
    )
    assert [r.id for r in lake.list_experiments(lake.metadata_keys(spark, str(tmp_path))).collect()] == ["two", "one"]


def test_missing_inputs_are_empty_typed_tables(spark, tmp_path):
    rows = lake.read_raw(spark, str(tmp_path / "nothing"), "responses")
    assert rows.count() == 0 and dict(rows.dtypes)["status"] == "bigint"


def test_partitions_are_pruned_and_columns_pushed(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([("e1", "u1", 0), ("e2", "u2", 1), (None, "u3", 0)], "experiment_id string, url string, crawl_depth bigint")
    lake.write_events(rows, root, "responses", records_per_file=1)
    lake.write_events(rows.drop("crawl_depth"), root, "requests")
    back = lake.read_raw(spark, root, "responses")
    assert {(r.experiment_id, r.url) for r in back.collect()} == {("e1", "u1"), ("e2", "u2"), ("default", "u3")}
    plan = back.filter("experiment_id = 'e1' AND crawl_depth = 0").select("url")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "experiment#" in scan.split("PartitionFilters")[1] and "EqualTo(crawl_depth,0)" in scan
    assert scan.split("ReadSchema: ")[1].startswith("struct<url:string,crawl_depth:bigint>")


def test_enrich_job(spark, tmp_path):
    root, out = str(tmp_path / "lake"), str(tmp_path / "out")
    document(tmp_path / "lake", "e1")
    document(tmp_path / "lake", "empty")
    columns = "experiment_id string, crawled_url string, crawl_session_id string, request_id string, url string, frame_url string, resource_type string, timestamp string"
    rows = [
        ("e1", "http://s/", "s1", "1", "http://t.com/a", "http://s/", "script", "1"),
        ("e1", "http://s/", "s1", "2", "http://s/", "http://s/", "document", "2"),
        ("e1", "http://s/", "s2", "3", "http://t.com/b", "http://s/", "script", "3"),
        ("no-document", "http://s/", "s3", "4", "http://t.com/c", "http://s/", "script", "4"),
    ]
    lake.write_events(conform(spark.createDataFrame(rows, columns), REQUESTS), root, "requests")
    site = spark.createDataFrame([("e1", "s1", "1", "news"), ("e1", "s2", "2", "sports")], SITE_METADATA)
    lake.write_events(site, root, "site_metadata")
    lake.write_workers(spark.createDataFrame([("w1", "DE", True, 1.0)], "worker_id string, country_code string, is_residential boolean, timestamp double"), root)
    (tmp_path / "easylist.txt").write_text("||t.com^\n")
    enrich(spark, root, out, f"{tmp_path}/easylist.txt,{tmp_path}/unreachable.txt")

    labeled = lake.read_enriched(spark, out, "labeled_requests")
    assert sorted((r.url, r.blocked_by) for r in labeled.collect()) == [("http://s/", "[]"), ("http://t.com/a", '["easylist"]')]
    assert [r.description for r in lake.read_enriched(spark, out, "site_metadata").collect()] == ["news"]
    assert {r.experiment_id for r in lake.read_enriched(spark, out, "worker_metadata").collect()} == {"e1"}
    for name in ("responses", "cookie_warning_consents"):
        assert lake.read_enriched(spark, out, name).count() == 0
        assert "crawl_session_id" in spark.read.parquet(f"{out}/{name}").columns
    assert lake.read_metadata(spark, out).count() == 2
    assert dict(lake.read_requests(labeled).dtypes)["crawl_depth"] == "bigint"


def test_result_tree_takes_the_experiment_from_the_path(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 200)], "request_id string, status bigint")
    rows.write.parquet(str(tmp_path / "exp1" / "enriched" / "responses.parquet"))
    back = lake.read_result_tree(spark, str(tmp_path), "responses")
    assert [(r.experiment_id, r.request_id, r.status) for r in back.collect()] == [("exp1", "r1", 200)]
    assert lake.read_result_tree(spark, str(tmp_path), "site_metadata").count() == 0


def test_enriched_tables_must_be_complete(tmp_path):
    with pytest.raises(ValueError):
        lake.write_enriched({}, str(tmp_path))


def test_sessions_and_sites_for_the_models(spark):
    sites = conform(spark.createDataFrame([("e", "s", "1704067207.5")], "experiment_id string, crawl_session_id string, timestamp string"), SITE_METADATA)
    assert lake.read_site_metadata(sites).first().scraped_at == datetime(2024, 1, 1, 1, 0, 7, 500000)
    assert lake.read_consent_sessions(sites.union(sites)).count() == 1
    assert lake.read_responses(conform(sites, RESPONSES)).columns == ["experiment_id", "crawl_session_id", "request_id", "status"]


def test_side_inputs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,google.com\n2,facebook.com\n")
    ranked = lists.read_tranco(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in tasks.top_seeds(ranked, 1).collect()] == [(1, "google.com", "https://google.com/")]
    (tmp_path / "countries.csv").write_text('"name","tld","cca2","region","subregion"\n"UK",".UK,.gb","GB","Europe","Northern Europe"\n"DE",".de","DE","Europe","West"\n')
    regions = lists.region_catalog(lists.read_countries(spark, str(tmp_path / "countries.csv")))
    assert {(r.tld_key, r.is_eu) for r in regions.collect()} == {("uk", False), ("gb", False), ("de", True)}


# -- tasks and status ------------------------------------------------------------------------------


def test_params_are_checked():
    assert tasks.validate_params({})["dwell_time"] == 30
    for bad in ({"browser_type": "lynx"}, {"depth": 1}, {"max_depth": "1"}, {"headless": 1}):
        with pytest.raises(ValueError):
            tasks.validate_params(bad)


def test_experiment_ids_and_rows(spark):
    name, digits = tasks.new_experiment_id("exp").split("_")
    assert name == "exp" and len(digits) == 8 and int(digits, 16) >= 0
    with pytest.raises(ValueError):
        tasks.new_experiment_id("not valid!")
    seeds = spark.createDataFrame([("https://a/",)], "url string")
    row = tasks.build_experiment(seeds, {}, "e", datetime(2024, 1, 1)).first()
    assert (row.id, row.total_urls, row.params.browser_type) == ("e", 1, "chromium")
    with pytest.raises(Exception, match="no URLs found"):
        tasks.build_experiment(seeds.limit(0), {}, "e", datetime(2024, 1, 1)).collect()


def test_task_subjects(spark):
    seeds = spark.createDataFrame([("https://a/",)], "url string")
    row = tasks.build_tasks(seeds, {"browser_type": "firefox", "scroll_amounts": [1]}, "exp1").first()
    assert (row.subject, row.scroll_amounts, row.dwell_time) == ("crawl.urls.firefox.headed.exp1", [1], 30)


def test_status(spark):
    documents = spark.createDataFrame(
        [("exp1", datetime(2024, 1, 1, 9, 5), 5), ("exp2", datetime(2024, 1, 2), 4), ("exp3", None, None), ("exp4", datetime(2024, 1, 3), 8)],
        "id string, timestamp timestamp, total_urls bigint",
    )
    depths = spark.createDataFrame(
        [("crawl.urls.chromium.headed.exp1", 2), ("crawl.urls.firefox.headless.exp1", 1), ("crawl.urls.x.exp4", 9), ("crawl.urls.a.b.exp44", 9)],
        "subject string, pending bigint",
    )
    rows = {r.id: tuple(r)[1:] for r in status.status_table(status.experiment_status(documents, depths)).collect()}
    assert rows == {
        "exp1": ("Running", "40.0%", "2/5", "2024-01-01 09:05"),
        "exp2": ("Done", "100.0%", "4/4", "2024-01-02 00:00"),
        "exp3": ("Error/Empty", "N/A", "0/0", "Unknown"),
        "exp4": ("Done", "100.0%", "8/8", "2024-01-03 00:00"),
    }
    unknown = status.status_table(status.experiment_status(documents, None)).first()
    assert tuple(unknown) == ("exp4", "Queue N/A", "N/A", "?/8", "2024-01-03 00:00")


def test_workers(spark):
    report = '{"ip": "x", "location": {"country_code": "DE"}, "risk": {"is_vpn": %s, "is_proxy": false, "is_datacenter": false}}'
    rows = [("a", report % "false", 1.0), ("b", report % "true", 2.0), ("c", "no json", 3.0), ("d", '{"ip": "x"}', 4.0)]
    frame = workers.classify_workers(spark.createDataFrame(rows, "worker_id string, report string, timestamp double"))
    assert {(r.worker_id, r.is_residential) for r in frame.collect()} == {("a", True), ("b", False)}
    assert [r.worker_id for r in workers.only_residential(frame).collect()] == ["a"]


def test_files_with_types_of_their_own(spark, tmp_path):
    """A collector infers types per file: numbers for text, columns that are all NULL, missing or unknown."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    base = {"crawl_session_id": "s", "crawled_url": "u", "url": "v", "crawl_depth": 0}
    files = {
        "a": [{**base, "timestamp": 1704067207}],
        "b": [{**base, "timestamp": 1704067207.1234567, "content_type": "x"}],
        "c": [{**base, "timestamp": "text", "url": None}],
        "d": [{"crawl_session_id": "s", "timestamp": None, "content_type": 5}],
        "e": [{**base, "timestamp": "again", "headers": {"a": "b"}}],
    }
    folder = tmp_path / "experiment=e" / "data_type=cookie_warning_consents"
    folder.mkdir(parents=True)
    for name, rows in files.items():
        pq.write_table(pa.Table.from_pylist(rows), folder / f"{name}.parquet")
    back = lake.read_raw(spark, str(tmp_path), "cookie_warning_consents")
    assert back.columns == [n for n, _ in columns(BY_DATA_TYPE["cookie_warning_consents"])] + ["content_type", "headers"]
    rows = back.collect()
    assert {(r.timestamp, r.url, r.crawl_depth, r.content_type) for r in rows} == {
        ("1704067207", "v", 0, None),
        ("1704067207.1234567", "v", 0, "x"),
        ("text", None, 0, None),
        (None, None, None, "5"),
        ("again", "v", 0, None),
    }


def test_writing_a_document_again_replaces_it(spark, tmp_path):
    schema = f"id string, timestamp timestamp, total_urls bigint, params {PARAMS}"
    params = (True, False, 0, 30, [], "firefox", True)
    for urls in (1, 2):
        lake.write_metadata(spark.createDataFrame([("one", datetime(2024, 1, 1), urls, params)], schema), str(tmp_path))
    assert [r.total_urls for r in lake.read_metadata(spark, str(tmp_path)).collect()] == [2]
    document(tmp_path, "one")  # an older description beside it
    assert lake.read_metadata(spark, str(tmp_path)).count() == 1


def test_many_documents_share_files(spark, tmp_path):
    """Files do not grow with the documents; a broken one is listed and not read; folders of their own count until written again."""
    root = str(tmp_path)
    ids = spark.range(0, 500, 1, 2).select(F.concat(F.lit("e"), "id").alias("id"), F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.col("id").alias("total_urls"))
    lake.write_metadata(ids.withColumn("params", F.struct(F.lit("firefox").alias("browser_type"))), root)
    lake.write_documents(spark.createDataFrame([("broken", '{"id": "brok'), ("e7", "{}")], "experiment string, value string"), root)
    assert len(list(tmp_path.rglob("*.parquet"))) < 10
    for name in ("e8", "old"):
        folder = tmp_path / f"experiment={name}" / "document=metadata"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(json.dumps({"id": name, "timestamp": "2025-01-01T00:00:00", "total_urls": 99, "params": {"browser_type": "firefox"}}))
    found = {r.exp_id: r.total_urls for r in lake.read_metadata(spark, root).collect()}
    assert found == {f"e{i}": i for i in range(500) if i != 7} | {"old": 99}
    listed = [r.id for r in lake.list_experiments(lake.metadata_keys(spark, root)).collect()]
    assert listed == sorted([f"e{i}" for i in range(500)] + ["broken", "old"], reverse=True)


def test_flushes_are_full_and_written_by_many_tasks(spark, tmp_path):
    """Files are full but for one per experiment, also with equal times, repeats and rows without experiment or time."""
    rows = spark.range(0, 2050, 1, 3).select(
        F.when(F.col("id") % 3 == 0, "e1").when(F.col("id") % 3 == 1, "e2").alias("experiment_id"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("time"),
        (F.col("id") % 900).cast("string").alias("request_id"),
    )
    lake.write_flushes(rows, str(tmp_path), "requests", F.col("time"), ["request_id"], records_per_file=100)
    files = spark.read.parquet(str(tmp_path)).groupBy("experiment", F.input_file_name().alias("file")).count().collect()
    sizes = {}
    for row in files:
        sizes.setdefault(row["experiment"], []).append(row["count"])
    assert {e: (sum(n), sorted(n)[0], sorted(n)[1], len(n)) for e, n in sizes.items()} == {
        "e1": (684, 84, 100, 7), "e2": (683, 83, 100, 7), "default": (683, 83, 100, 7)
    }
    assert len({row["file"].rsplit("/", 1)[1].split("-")[1] for row in files}) > 1


def test_more_experiments_than_open_files(spark, tmp_path):
    """One task writes far more partitions than it holds files open: every row once, full files, and the session as before."""
    rows = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("e"), F.col("id") % 25).alias("experiment_id"), F.col("id").cast("string").alias("request_id"))
    seen, name = [], "spark.sql.maxConcurrentOutputFileWriters"
    lake.write_events(rows, str(tmp_path / "lake"), "requests", records_per_file=30)
    found = spark.read.parquet(str(tmp_path / "lake")).groupBy("experiment", F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("d"))
    for row in found.collect():
        assert row.n == row.d
        seen.append((row.experiment, row.n))
    assert sorted(seen) == sorted((f"e{i}", n) for i in range(25) for n in (20, 30, 30))
    lake.write_table(rows, str(tmp_path / "table"), ["experiment_id"])
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "table")).collect()) == sorted(str(i) for i in range(2000))
    assert spark.conf.get(name, None) is None
