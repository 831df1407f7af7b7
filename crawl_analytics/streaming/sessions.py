"""Session choice in the stream: counts per session are kept as state, the kept session of a seed is emitted when it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .jobs import with_event_time

KEPT = "experiment_id string, crawled_url string, keep_session string, req_count long, is_final boolean"
PARTIAL = "experiment_id string, crawled_url string, crawl_session_id string, n long, event_time timestamp"
KEYS = ["experiment_id", "crawled_url", "crawl_session_id"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of a batch summed per session before they are shuffled; a missing time counts as the batch's latest."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(KEYS).aggregate([([], "count_all"), ("event_time", "max")])
        if sums.num_rows:
            latest = pa.compute.max(sums["event_time_max"])
            time = pa.compute.fill_null(sums["event_time_max"], latest if latest.is_valid else pa.scalar(0, sums["event_time_max"].type))
            columns = [*[sums[k] for k in KEYS], sums["count_all"].cast(pa.int64()), time]
            yield from pa.table(columns, names=[*KEYS, "n", "event_time"]).to_batches()


class _Choice(StatefulProcessor):
    """The state of a seed: requests per session, the session kept so far, and when the seed counts as silent."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "crawl_session_id string", "n long")
        self.best = handle.getValueState("best", "n long, crawl_session_id string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added: dict[str, int] = {}
        latest = 0
        for row in rows:
            added[row.crawl_session_id] = added.get(row.crawl_session_id, 0) + row.n
            latest = max(latest, int(row.event_time.timestamp() * 1000))
        last = self.best.get() if self.best.exists() else None
        best = (-last[0], last[1]) if last else None
        for session, n in added.items():
            before = self.counts.getValue((session,))[0] if self.counts.containsKey((session,)) else 0
            self.counts.updateValue((session,), (before + n,))
            # counts only grow, so only sessions with new requests can take the lead
            mine = (-(before + n), session)
            best = mine if best is None or mine < best else best
        self._wait(latest + self.gap_ms)
        if last is None or (-best[0], best[1]) != tuple(last):
            self.best.update((-best[0], best[1]))
            yield Row(experiment_id=key[0], crawled_url=key[1], keep_session=best[1], req_count=-best[0], is_final=False)

    def _wait(self, until: int) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or until > due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(until)
            self.due.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, session = self.best.get()
        for state in (self.counts, self.best, self.due):
            state.clear()
        yield Row(experiment_id=key[0], crawled_url=key[1], keep_session=session, req_count=n, is_final=True)

    def close(self) -> None:
        pass


def kept_session_updates(requests: DataFrame, delay: str = "1 hour", gap_seconds: int = 86_400) -> DataFrame:
    """(experiment_id, crawled_url, keep_session, req_count, is_final): a stream of changes, for update mode.

    A seed's session is kept that has most requests, then the smaller id. Requests are summed per session in their own
    task before the exchange, so a hot seed sends one row per session and batch. When the watermark (``delay`` behind
    the latest request) has passed a seed's last request by ``gap_seconds``, its choice is emitted as final and its state is dropped:
    state is held for seeds that are being visited only. Requests without a seed or session are left out.
    """
    timed = with_event_time(requests).select(*KEYS, "event_time").where("crawled_url is not null and crawl_session_id is not null")
    partial = timed.mapInArrow(_counted, PARTIAL).withWatermark("event_time", delay)
    seeds = partial.groupBy("experiment_id", "crawled_url")
    return seeds.transformWithState(_Choice(gap_seconds * 1000), KEPT, "Update", "EventTime")


def start_session_choice(requests: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", gap_seconds: int = 86_400, trigger: dict | None = None) -> StreamingQuery:
    """Keep the changes below ``out``, a folder per micro-batch that a repeated batch writes again: every change is there once."""
    spark = requests.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = kept_session_updates(requests, delay, gap_seconds).writeStream.outputMode("update").foreachBatch(keep)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # several state variables and timers need it; the query keeps the setting it starts with
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(STORE, before)


def read_kept_sessions(spark: SparkSession, out: str) -> DataFrame:
    """(experiment_id, crawled_url, keep_session, req_count) as of the last batch: counts only grow, so the largest is the latest."""
    changes = spark.read.schema(KEPT).parquet(out)
    best = F.min(F.struct((-F.col("req_count")).alias("n"), F.col("keep_session").alias("s"))).alias("b")
    return changes.groupBy("experiment_id", "crawled_url").agg(best).select("experiment_id", "crawled_url", F.col("b.s").alias("keep_session"), (-F.col("b.n")).alias("req_count"))
