import json

import pytest
from pyspark.sql import functions as F

from crawl_analytics.sources import lake
from crawl_analytics.streaming import commits, compaction

ENVELOPE = "experiment string, worker_id string, data_type string, event string"


def batch(spark, ids):
    rows = []
    for i in ids:
        request = {"request_id": str(i), "crawl_session_id": "s", "url": "u", "timestamp": str(1000 - i)}
        rows.append((None if i % 5 == 0 else f"e{i % 2}", "w", "requests", json.dumps(request)))
        rows.append(("system", "w", "site_metadata", json.dumps({"crawl_session_id": f"s{i}", "timestamp": "1", "description": "d"})))
    return spark.createDataFrame([*rows, ("e1", "w", "requests", "broken {")], ENVELOPE)


def seen(spark, root):
    requests = lake.read_raw(spark, root, "requests", committed=True)
    unread = lake.read_unreadable(spark, root, committed=True)
    system = lake.read_raw(spark, root, "site_metadata", committed=True, system=True)
    return sorted(map(str, requests.collect())), sorted(map(str, unread.collect())), sorted(map(str, system.collect()))


def live(spark, root):
    return sorted(r.batch for r in lake.commit_log(spark, root).collect())


def test_compaction(spark, tmp_path, monkeypatch):
    """Rows stay, a run that breaks is not seen, the stream goes on, results are compacted again, old files go when asked."""
    root = str(tmp_path / "lake")
    assert compaction.compact(spark, root) is None
    for number in range(3):
        commits.write_batch(batch(spark, range(10 * number, 10 * number + 10)), root, number)
    before, first = seen(spark, root), compaction.COMPACTED + 1

    plain = compaction.write_events

    def failing(rows, path, kind, records=lake.FILE_RECORDS):
        plain(rows, path, kind, records)
        raise OSError("disk gone")

    monkeypatch.setattr(compaction, "write_events", failing)
    with pytest.raises(OSError):
        compaction.compact(spark, root)
    assert live(spark, root) == [0, 1, 2] and seen(spark, root) == before
    monkeypatch.setattr(compaction, "write_events", plain)

    assert compaction.compact(spark, root) == first
    assert live(spark, root) == [first] and seen(spark, root) == before
    assert compaction.compact(spark, root) is None
    files = compaction.batch_files(spark, root, lake.commit_log(spark, root))
    assert {(r.experiment, r.data_type, r["count"]) for r in files.groupBy("experiment", "data_type").count().collect()} == {
        ("e0", "requests", 1), ("e1", "requests", 1), ("default", "requests", 1), ("system", "site_metadata", 1), ("e1", "unreadable", 1)
    }

    commits.write_batch(batch(spark, range(99, 100)), root, 1)  # the stream asks again for a batch that was replaced
    assert seen(spark, root) == before
    for number in (3, 4):
        commits.write_batch(batch(spark, range(10 * number, 10 * number + 10)), root, number)
    before = seen(spark, root)
    assert compaction.compact(spark, root) == first + 1 and live(spark, root) == [first, first + 1]
    assert compaction.compact(spark, root, again=True) == first + 2 and live(spark, root) == [first + 2]
    assert seen(spark, root) == before
    assert commits.drop_uncommitted(spark, root) == [0, 1, 2, 3, 4, first, first + 1]
    assert seen(spark, root) == before and len(before[0]) == 50


def test_files_are_dealt_by_size_and_sorted(spark, tmp_path):
    """One experiment with nearly all rows becomes many files, each a span of time of its own."""
    root = str(tmp_path / "lake")
    for number in range(2):
        commits.write_batch(batch(spark, range(600 * number, 600 * number + 600)), root, number)
    size = compaction.batch_files(spark, root, lake.commit_log(spark, root)).where("data_type = 'requests'").agg(F.sum("length")).first()[0]
    number = compaction.compact(spark, root, file_bytes=size // 6)
    rows = spark.read.parquet(f"{root}/batch={number}/experiment=e1/data_type=requests").select("timestamp", F.input_file_name().alias("file"))
    spans = sorted((r.low, r.high) for r in rows.groupBy("file").agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
