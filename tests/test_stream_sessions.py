from collections import Counter

from pyspark.sql import functions as F

from crawl_analytics.operators import enrich
from crawl_analytics.schemas import REQUESTS, conform
from crawl_analytics.streaming import sessions

DAY = 86_400


def requests(spark, rows):
    """(seed, session, seconds) rows as raw requests."""
    frame = spark.createDataFrame([("e", u, s, None if t is None else f"{t}.000000") for u, s, t in rows], "experiment_id string, crawled_url string, crawl_session_id string, timestamp string")
    return conform(frame, REQUESTS)


def run(spark, source, out, marks, **kw):
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = sessions.start_session_choice(stream, out, marks, **kw)
    query.awaitTermination()
    return query


def test_choice_over_batches_and_a_restart(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    first = [("u1", "a", 100), ("u1", "a", 101), ("u1", "b", 102), ("u2", "x", 100), ("u2", "y", None)]
    second = [("u1", "b", 200), ("u1", "b", 201), ("u2", "y", 210), ("u2", "x", 220), ("u3", "n", 230)]
    requests(spark, first).coalesce(1).write.parquet(source)
    run(spark, source, out, marks)
    kept = lambda: {r.crawled_url: (r.keep_session, r.req_count) for r in sessions.read_kept_sessions(spark, out).collect()}
    assert kept() == {"u1": ("a", 2), "u2": ("x", 1)}
    requests(spark, second).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, marks)  # a restart goes on with the counts it had
    assert kept() == {"u1": ("b", 3), "u2": ("x", 2), "u3": ("n", 1)}
    whole = enrich.kept_sessions(requests(spark, first + second)).collect()
    assert kept() == {r.crawled_url: (r.keep_session, r.req_count) for r in whole}


def test_silent_seeds_are_final_and_leave_no_state(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for day in range(4):
        rows = [(f"u{day}", "s", day * 10 * DAY + i) for i in range(3)] + [("busy", f"s{day % 2}", day * 10 * DAY + 5)]
        requests(spark, rows).coalesce(1).write.mode("append").parquet(source)
    query = run(spark, source, out, marks, gap_seconds=DAY)
    final = spark.read.schema(sessions.KEPT).parquet(out).where("is_final").collect()
    assert {r.crawled_url for r in final} >= {"u0", "u1", "u2"} and all(r.req_count == 3 for r in final if r.crawled_url != "busy")
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] < 12  # the last day's seeds only


def test_requests_are_summed_before_the_exchange():
    import datetime

    import pyarrow as pa

    zone = datetime.UTC
    times = [datetime.datetime(2024, 1, 1, 0, 0, i, tzinfo=zone) for i in range(6)]
    rows = {"experiment_id": ["e"] * 6, "crawled_url": ["u"] * 6, "crawl_session_id": list("aabbba"), "event_time": [*times[:5], None]}
    batch = pa.RecordBatch.from_pydict(rows, schema=pa.schema([*[(c, pa.string()) for c in sessions.KEYS], ("event_time", pa.timestamp("us", "UTC"))]))
    out = pa.Table.from_batches(sessions._counted([batch, batch.slice(0, 0)])).to_pylist()
    assert Counter({r["crawl_session_id"]: r["n"] for r in out}) == {"a": 3, "b": 3}
    assert {r["crawl_session_id"]: r["event_time"] for r in out} == {"a": times[1], "b": times[4]}


def test_late_parts_of_a_seed(spark, tmp_path):
    """Rows without a session or seed are left out; two experiments do not mix."""
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = requests(spark, [("u", "a", 1), ("u", None, 2), (None, "a", 3)])
    rows.unionByName(rows.withColumn("experiment_id", F.lit("f"))).write.parquet(source)
    run(spark, source, out, marks)
    got = sessions.read_kept_sessions(spark, out).collect()
    assert sorted((r.experiment_id, r.crawled_url, r.keep_session, r.req_count) for r in got) == [("e", "u", "a", 1), ("f", "u", "a", 1)]
