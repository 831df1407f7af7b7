import json

import pytest

from crawl_analytics.sources import lake
from crawl_analytics.streaming import commits, events

ENVELOPE = "experiment string, worker_id string, data_type string, event string"


def deliver(spark, path, ids):
    rows = []
    for i in ids:
        rows.append(("e1", "w", "requests", json.dumps({"request_id": str(i), "crawl_session_id": "s", "url": "u", "timestamp": "1.5"})))
        rows.append(("e2", "w", "site_metadata", json.dumps({"crawl_session_id": f"s{i}", "timestamp": "1", "description": "d"})))
        rows.append(("e1", "w", "requests", "broken {"))
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, root, marks):
    stream = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(source)
    commits.start_committed_sink(stream, root, marks).awaitTermination()


def seen(spark, root):
    requests = sorted(int(r.request_id) for r in lake.read_raw(spark, root, "requests", committed=True).collect())
    return requests, lake.read_raw(spark, root, "site_metadata", committed=True).count(), lake.read_unreadable(spark, root, committed=True).count()


@pytest.mark.parametrize("broken", [1, 3, 5])
def test_a_batch_that_breaks_is_not_seen_and_then_there_once(spark, tmp_path, monkeypatch, broken):
    """The second batch breaks at its first, third or fifth write; readers see the first batch, after a restart every event once."""
    source, root, marks = (str(tmp_path / n) for n in ("in", "lake", "marks"))
    deliver(spark, source, range(3))
    run(spark, source, root, marks)
    deliver(spark, source, range(3, 7))
    calls, plain = [], commits.write_events

    def failing(rows, path, kind, records):
        calls.append(kind)
        plain(rows, path, kind, records)
        if len(calls) == broken:
            raise OSError("disk gone")

    monkeypatch.setattr(commits, "write_events", failing)
    with pytest.raises(Exception, match="disk gone"):
        run(spark, source, root, marks)
    assert seen(spark, root) == ([0, 1, 2], 3, 3)
    assert lake.read_raw(spark, f"{root}/batch=1", "requests").count() == 4  # the broken attempt's files are there
    monkeypatch.setattr(commits, "write_events", plain)
    run(spark, source, root, marks)
    assert seen(spark, root) == ([0, 1, 2, 3, 4, 5, 6], 7, 7)


def test_a_batch_asked_for_again_after_its_commit(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    deliver(spark, source, range(2))
    batch = spark.read.schema(ENVELOPE).parquet(source)
    for _ in range(2):
        commits.write_batch(batch, root, 0)
    assert seen(spark, root) == ([0, 1], 2, 2)


def test_uncommitted_batches_can_be_dropped(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    deliver(spark, source, range(2))
    batch = spark.read.schema(ENVELOPE).parquet(source)
    commits.write_batch(batch, root, 4)
    lake.write_events(events.to_requests(batch), f"{root}/batch=5", "requests")
    assert commits.drop_uncommitted(spark, root) == [5] and seen(spark, root)[0] == [0, 1]
    assert [r.id for r in lake.experiments_with_rows(spark, root, ["requests"], committed=True).collect()] == ["e1"]


def test_nothing_committed(spark, tmp_path):
    assert seen(spark, str(tmp_path)) == ([], 0, 0)
