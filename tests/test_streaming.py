import json

from pyspark.sql import functions as F

from crawl_analytics.schemas import REQUESTS, conform
from crawl_analytics.sources import lake
from crawl_analytics.streaming import events, jobs

ENVELOPE = "experiment string, worker_id string, data_type string, event string"


def response(**changes):
    event = {
        "request_id": "1",
        "crawl_session_id": "s",
        "crawled_url": "u",
        "url": "u/a",
        "status": 200,
        "headers": {"content-type": "text/html", "x": 'q"é'},
        "set_cookie": ["a=1", "b=2"],
        "timing": {"startTime": 100.0, "responseStart": 789.0},
        "crawl_depth": 0,
        **changes,
    }
    return ("e", "w", "responses", json.dumps(event))


def test_response_fields(spark):
    rows = [response(), response(timing={}), response(timing={"startTime": 1704067207179.123}), ("e", "w", "responses", "{ bad")]
    out = events.to_responses(spark.createDataFrame(rows, ENVELOPE)).collect()
    assert sorted(r.timestamp for r in out) == ["0", "1704067207179.123", "889.0"]
    assert out[0].headers == json.dumps({"content-type": "text/html", "x": 'q"é'})
    assert out[0].cookies == json.dumps(["a=1", "b=2"])


def test_request_fields(spark):
    event = {"request_id": "1", "crawl_session_id": "s", "timestamp": 1704067207.5, "url": "u", "resource_type": "script"}
    rows = [("e", "w7", "requests", json.dumps(event)), (None, "w7", "requests", json.dumps({**event, "frame_url": "f"}))]
    out = {r.frame_url: r for r in events.route(events.to_requests(spark.createDataFrame(rows, ENVELOPE))).collect()}
    assert (out[""].worker_id, out[""].headers, out[""].timestamp, out[""].experiment) == ("w7", "{}", "1704067207.5", "e")
    assert out["f"].experiment == "default"
    stamped = events.stamp_worker(events.to_requests(spark.createDataFrame(rows, ENVELOPE).drop("worker_id")), "w1")
    assert {r.worker_id for r in stamped.collect()} == {"w1"}


def test_consent_time_may_be_a_number(spark):
    rows = [("e", "w", "cookie_warning_consents", '{"crawl_session_id": "s", "crawled_url": "u", "url": "v", "timestamp": 1704067207179, "crawl_depth": 0}')]
    assert events.to_consents(spark.createDataFrame(rows, ENVELOPE)).first().timestamp == "1704067207179"


def test_description_is_cut(spark):
    rows = [("e", "w", "site_metadata", json.dumps({"crawl_session_id": "s", "timestamp": "1", "description": "x" * 700}))]
    assert events.to_site_metadata(spark.createDataFrame(rows, ENVELOPE)).first().description == "x" * 500


def test_sink_writes_what_the_batch_gives_and_resumes(spark, tmp_path):
    source, root, marks = (str(tmp_path / n) for n in ("in", "lake", "marks"))
    first = spark.createDataFrame([response(request_id=str(i)) for i in range(5)], ENVELOPE)
    first.write.parquet(source)
    stream = spark.readStream.schema(ENVELOPE).parquet(source)
    jobs.start_event_sink(stream, root, marks, records_per_file=2).awaitTermination()
    again = spark.createDataFrame([response(request_id="9", experiment_id="other")], ENVELOPE)
    again.write.mode("append").parquet(source)
    jobs.start_event_sink(spark.readStream.schema(ENVELOPE).parquet(source), root, marks).awaitTermination()
    got = lake.read_raw(spark, root, "responses").select("experiment_id", "request_id", "timestamp", "headers").collect()
    batch = events.to_responses(spark.read.schema(ENVELOPE).parquet(source)).select("experiment_id", "request_id", "timestamp", "headers").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(got) == 6


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = spark.createDataFrame([("e", "s", str(i), f"{1704067200 + i}.5") for i in range(6)], "experiment_id string, crawl_session_id string, request_id string, timestamp string")
    conform(rows, REQUESTS).coalesce(1).write.parquet(source)
    conform(rows.limit(3), REQUESTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.with_event_time(spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source))
        once = jobs.dedup_stream(stream, ["experiment_id", "crawl_session_id", "request_id"], "event_time", "1 hour")
        once.drop("event_time").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    run()
    conform(rows.limit(2), REQUESTS).write.mode("append").parquet(source)
    run()
    got = spark.read.schema(REQUESTS).parquet(out)
    assert sorted(r.request_id for r in got.collect()) == [str(i) for i in range(6)]


def test_progress_counts_sessions_once(spark, tmp_path):
    source, marks = (str(tmp_path / n) for n in ("in", "marks"))
    rows = spark.createDataFrame(
        [("a", f"s{i % 4}", str(i), f"{1704067200 + i}") for i in range(12)] + [("b", "s0", "x", "1704067200")],
        "experiment_id string, crawl_session_id string, request_id string, timestamp string",
    )
    conform(rows, REQUESTS).write.parquet(source)
    counts = jobs.stream_progress(spark.readStream.schema(REQUESTS).parquet(source))
    got = {}

    def keep(batch, _):
        got.update({r.experiment_id: r.sites_completed for r in batch.collect()})

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    assert got == {"a": 4, "b": 1}


def test_events_that_cannot_be_read_are_kept(spark):
    rows = [response(), ("e", "w", "responses", "{ bad"), ("e", "w", "news", "{}"), (None, "w", "requests", '{"url": "u"}'), ("e", "w", None, None)]
    out = events.to_unreadable(spark.createDataFrame(rows, ENVELOPE)).collect()
    assert {(r.experiment_id, r.kind, r.event) for r in out} == {("e", "responses", "{ bad"), ("e", "news", "{}"), (None, "requests", '{"url": "u"}'), ("e", None, None)}


def test_time_and_headers_as_text(spark):
    texts = {"1704067207.1234567": "1704067207.1234567", 1704067207.1234567: "1704067207.1234567", "later": "later", 5: "5.0"}
    for given, kept in texts.items():
        event = {"crawl_session_id": "s", "timestamp": given, "headers": json.dumps({"a": "b"})}
        row = events.to_requests(spark.createDataFrame([("e", "w", "requests", json.dumps(event))], ENVELOPE)).first()
        assert (row.timestamp, row.headers) == (kept, json.dumps({"a": "b"}))


def test_a_batch_is_many_files(spark):
    """Micro-batches are as many as asked for and none of them is one file, which one task would have to read."""
    from crawl_analytics.fixtures import Fixture
    from crawl_analytics.queries import _deliveries
    from crawl_analytics.session import new_run_dir

    rows = spark.range(400).selectExpr("'e' AS experiment", "'w' AS worker_id", "'requests' AS data_type", "string(id) AS event")
    stream, seen = _deliveries(Fixture(spark, "/nothing"), rows, 2), []
    flush = lambda batch, _: seen.append((batch.count(), len(batch.select(F.input_file_name()).distinct().collect())))
    stream.writeStream.foreachBatch(flush).option("checkpointLocation", new_run_dir(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(n for n, _ in seen) == 400 and min(files for _, files in seen) > 1
