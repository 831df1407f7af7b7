"""Event projections. They work on streaming and on batch frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_EXPERIMENT, DESCRIPTION_CHARS
from ..functions import jsontext

REQUEST_EVENT = (
    "experiment_id string, request_id string, crawl_session_id string, timestamp string, crawled_url string, "
    "current_page_url string, url string, frame_url string, resource_type string, method string, "
    "headers string, crawl_depth bigint"
)
RESPONSE_EVENT = (
    "experiment_id string, request_id string, crawl_session_id string, crawled_url string, url string, "
    "status bigint, headers string, set_cookie array<string>, "
    "timing struct<startTime: double, responseStart: double>, crawl_depth bigint"
)
CONSENT_EVENT = (
    "experiment_id string, crawl_session_id string, crawled_url string, url string, timestamp string, crawl_depth bigint"
)
SITE_EVENT = "experiment_id string, crawl_session_id string, timestamp string, description string"
KINDS = {
    "requests": REQUEST_EVENT,
    "responses": RESPONSE_EVENT,
    "cookie_warning_consents": CONSENT_EVENT,
    "site_metadata": SITE_EVENT,
}


def _readable(kind: str) -> Column:
    """Whether the event is JSON of the kind with a session id."""
    return F.from_json("event", KINDS[kind])["crawl_session_id"].isNotNull()


def _read(events: DataFrame, kind: str) -> DataFrame:
    """Events (experiment, data_type, event JSON) of one kind, parsed to ``e``; for the others see ``to_unreadable``."""
    chosen = events.filter(F.col("data_type") == kind).withColumn("e", F.from_json("event", KINDS[kind]))
    session = F.coalesce("e.experiment_id", "experiment")
    return chosen.filter(F.col("e.crawl_session_id").isNotNull()).withColumn("experiment_id", session)


def to_unreadable(events: DataFrame) -> DataFrame:
    """Events that no projection takes: unknown kinds, broken JSON, no session id; with their text."""
    taken = F.lit(False)
    for kind in KINDS:
        taken = taken | (F.col("data_type").eqNullSafe(kind) & _readable(kind))
    worker = F.col("worker_id") if "worker_id" in events.columns else F.lit("")
    return events.filter(~taken).select(F.col("experiment").alias("experiment_id"), worker.alias("worker_id"), F.col("data_type").alias("kind"), "event")


def to_requests(events: DataFrame) -> DataFrame:
    """Request rows; the frame URL is '' when there is no frame, headers become JSON text.

    Time and headers may be a number and an object, as browsers send them, or text, as collectors do.

    The worker id is taken from the envelope when it has one.
    """
    e = _read(events, "requests")
    worker = F.col("worker_id") if "worker_id" in events.columns else F.lit("")
    return e.select(
        "experiment_id",
        "e.request_id",
        worker.alias("worker_id"),
        "e.crawl_session_id",
        "e.crawled_url",
        "e.current_page_url",
        "e.url",
        F.coalesce("e.frame_url", F.lit("")).alias("frame_url"),
        "e.resource_type",
        "e.method",
        jsontext.map_text(F.col("e.headers")).alias("headers"),
        jsontext.number_text(F.col("e.timestamp")).alias("timestamp"),
        "e.crawl_depth",
    )


def _response_time(timing: Column) -> Column:
    """Start plus response start in milliseconds, as text; a missing part counts as 0."""
    start, response = timing["startTime"], timing["responseStart"]
    both = F.coalesce(start, F.lit(0.0)) + F.coalesce(response, F.lit(0.0))
    return F.when(start.isNull() & response.isNull(), F.lit("0")).otherwise(jsontext.float_text(both))


def to_responses(events: DataFrame) -> DataFrame:
    """Response rows; headers and set-cookie values become JSON text."""
    e = _read(events, "responses")
    return e.select(
        "experiment_id",
        "e.request_id",
        "e.crawl_session_id",
        "e.crawled_url",
        "e.url",
        "e.status",
        jsontext.map_text(F.col("e.headers")).alias("headers"),
        _response_time(F.col("e.timing")).alias("timestamp"),
        jsontext.json_list(F.col("e.set_cookie")).alias("cookies"),
        "e.crawl_depth",
    )


def to_consents(events: DataFrame) -> DataFrame:
    """Consent rows; the time may be a number in the event and is text in the row."""
    e = _read(events, "cookie_warning_consents")
    return e.select("experiment_id", "e.crawl_session_id", "e.crawled_url", "e.url", "e.timestamp", "e.crawl_depth")


def to_site_metadata(events: DataFrame) -> DataFrame:
    """Site metadata rows; the description is cut to 500 characters."""
    e = _read(events, "site_metadata")
    text = F.substring(F.coalesce("e.description", F.lit("")), 1, DESCRIPTION_CHARS)
    return e.select("experiment_id", "e.crawl_session_id", "e.timestamp", text.alias("description"))


PROJECTIONS = {
    "requests": to_requests,
    "responses": to_responses,
    "cookie_warning_consents": to_consents,
    "site_metadata": to_site_metadata,
}


def stamp_worker(rows: DataFrame, worker: str | Column) -> DataFrame:
    """Requests with the id of the worker that saw them."""
    return rows.withColumn("worker_id", F.lit(worker) if isinstance(worker, str) else worker)


def route(rows: DataFrame) -> DataFrame:
    """Rows with the experiment they are stored under; none means ``default``."""
    return rows.withColumn("experiment", F.coalesce("experiment_id", F.lit(DEFAULT_EXPERIMENT)))
