"""Streaming jobs: event sink, removal of repeats, live progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import times
from ..sources.lake import FILE_RECORDS, UNREADABLE, write_events
from .events import PROJECTIONS, to_unreadable


def start_event_sink(
    events: DataFrame,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    records_per_file: int = FILE_RECORDS,
) -> StreamingQuery:
    """Write a stream of (experiment, data_type, worker_id, event JSON) to the raw lake.

    A micro-batch takes the place of the flush; its offsets are committed after the
    rows are written, and a failed batch is written again (at least once). Repeats
    are removed by the enrichment. Events that cannot be read or have an unknown kind are kept with
    their text under ``data_type=unreadable``. ``trigger`` is e.g. ``{"availableNow": True}`` or
    ``{"processingTime": "30 seconds"}``.
    """

    def flush(batch: DataFrame, _: int) -> None:
        batch.persist()
        for kind, project in PROJECTIONS.items():
            rows = project(batch)
            write_events(rows, root, kind, records_per_file)
        write_events(to_unreadable(batch), root, UNREADABLE, records_per_file)
        batch.unpersist()

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def dedup_stream(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop exact repeats of a key that arrive within ``delay``; the state is bounded by the watermark.

    Choosing between whole sessions needs all of their rows and stays in batch.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def with_event_time(requests: DataFrame, into: str = "event_time") -> DataFrame:
    """Adds the request time as a timestamp, for watermarks."""
    return requests.withColumn(into, F.timestamp_micros(times.epoch_micros(F.col("timestamp"))))


def stream_progress(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sites started per experiment: sessions seen first, counted; for complete or update mode."""
    timed = with_event_time(requests).withWatermark("event_time", delay)
    first = timed.dropDuplicatesWithinWatermark(["experiment_id", "crawl_session_id"])
    return first.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("sites_completed"))
