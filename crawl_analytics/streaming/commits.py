"""A sink that commits: a micro-batch's files count only once its entry is in the commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lake import COMMITS, FILE_RECORDS, UNREADABLE, commit_log, write_events
from .events import PROJECTIONS, to_unreadable


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def is_committed(spark: SparkSession, root: str, number: int) -> bool:
    system, path = _path(spark, f"{root}/{COMMITS}/batch={number}/done")
    return system.exists(path) and system.getFileStatus(path).getLen() > 0


def enter(spark: SparkSession, root: str, number: int, entry: str = "done") -> None:
    """Enter a batch into the log: one file of a byte, which is there or not (listings leave out empty ones)."""
    system, path = _path(spark, f"{root}/{COMMITS}/batch={number}/{entry}")
    out = system.create(path, True)
    out.write(1)
    out.close()


def abort(spark: SparkSession, root: str, number: int) -> None:
    """Remove what a broken attempt at a batch has written."""
    system, path = _path(spark, f"{root}/batch={number}")
    system.delete(path, True)


def write_batch(batch: DataFrame, root: str, number: int, records_per_file: int = FILE_RECORDS) -> None:
    """Write all kinds of events of a micro-batch and commit them together.

    A batch that is in the log has been written whole and is skipped: the stream asks for it again if it broke between
    the commit and its own checkpoint. What an earlier attempt left without a commit is removed first. A broken attempt
    leaves files behind that no reader sees.
    """
    spark = batch.sparkSession
    if is_committed(spark, root, number):
        return
    abort(spark, root, number)
    batch.persist()
    try:
        for kind, project in PROJECTIONS.items():
            write_events(project(batch), f"{root}/batch={number}", kind, records_per_file)
        write_events(to_unreadable(batch), f"{root}/batch={number}", UNREADABLE, records_per_file)
    finally:
        batch.unpersist()
    enter(spark, root, number)


def start_committed_sink(events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, records_per_file: int = FILE_RECORDS) -> StreamingQuery:
    """Write a stream of (experiment, data_type, worker_id, event JSON) to a lake of committed batches: exactly once.

    One checkpoint writes to one ``root``; batches are told apart by their numbers. Read it with ``read_raw(..., committed=True)``.
    """
    spark = events.sparkSession

    def flush(batch: DataFrame, number: int) -> None:
        write_batch(batch, root, number, records_per_file)

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    system, path = _path(spark, f"{root}/{COMMITS}")
    system.mkdirs(path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drop_uncommitted(spark: SparkSession, root: str) -> list[int]:
    """Remove the batches that broke or were replaced, while no sink, compaction or reader runs; their numbers."""
    system, path = _path(spark, root)
    found = [s.getPath().getName() for s in system.listStatus(path)]
    numbers = sorted(int(n.removeprefix("batch=")) for n in found if n.startswith("batch="))
    known = {r["batch"] for r in commit_log(spark, root).where(F.col("batch").isin(numbers)).collect()} if numbers else set()
    broken = [n for n in numbers if n not in known]
    for number in broken:
        abort(spark, root, number)
    return broken
