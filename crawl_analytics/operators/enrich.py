"""Removing the repeats left by at-least-once delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import first_rows, group_by, hot_buckets, is_small, latest_rows, salted_join

SESSION = ["experiment_id", "crawled_url", "crawl_session_id"]
SEED = ["experiment_id", "crawled_url"]


def session_counts(requests: DataFrame) -> DataFrame:
    """Requests per (experiment, seed, session)."""
    return requests.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("req_count"))


def kept_sessions(requests: DataFrame) -> DataFrame:
    """The session kept for each (experiment, seed): most requests, then the smaller id."""
    counts = session_counts(requests)
    best = F.min(F.struct((-F.col("req_count")).alias("n"), F.col("crawl_session_id").alias("s")))
    return group_by(counts, SEED).agg(best.alias("b")).select(
        *SEED, F.col("b.s").alias("keep_session"), (-F.col("b.n")).alias("req_count")
    )


def _kept_keys(kept: DataFrame) -> DataFrame:
    return kept.select(*SEED, F.col("keep_session").alias("crawl_session_id"))


def _one_per_url(rows: DataFrame, kept: DataFrame) -> DataFrame:
    # Sessions that are not kept go first, by their keys alone; a seed keeps one
    # session, so one row per session and URL is one row per seed and URL.
    order = [c for c in ("timestamp", "request_id") if c in rows.columns]
    keys = _kept_keys(kept)
    if is_small(keys):
        mine = rows.join(F.broadcast(keys), SESSION, "left_semi")
    else:
        # A session has no more requests than the kept one of its seed, so the seeds
        # that are hot can be read off the kept sessions, a far smaller table.
        hot = hot_buckets(kept, [SEED], weight="req_count")[0]
        mine = salted_join(rows, keys, SESSION, "left_semi", spread=["url"], hot=hot, hot_on=SEED)
    return first_rows(mine, [*SESSION, "url"], order).select(*rows.columns)


def dedup_requests(requests: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Requests of kept sessions, one per (experiment, seed, URL): the earliest, then the smaller id."""
    return _one_per_url(requests, kept_sessions(requests) if kept is None else kept)


def dedup_responses(responses: DataFrame, kept: DataFrame) -> DataFrame:
    """Responses of kept sessions, one per (experiment, seed, URL)."""
    return _one_per_url(responses, kept)


def dedup_consents(consents: DataFrame, kept: DataFrame) -> DataFrame:
    """Consents of kept sessions, one per (experiment, seed)."""
    single = first_rows(consents, SESSION, [c for c in ("timestamp", "url") if c in consents.columns])
    return single.join(_kept_keys(kept), SESSION, "left_semi").select(*consents.columns)


def dedup_site_metadata(site_metadata: DataFrame, kept: DataFrame) -> DataFrame:
    """Site metadata of kept sessions, one per (experiment, session)."""
    key = ["experiment_id", "crawl_session_id"]
    single = first_rows(site_metadata, key, [c for c in ("timestamp",) if c in site_metadata.columns])
    return single.join(_kept_keys(kept).select(*key).distinct(), key, "left_semi").select(*site_metadata.columns)


def dedup_workers(workers: DataFrame, strict: bool = False) -> DataFrame:
    """The latest row per worker, inside each experiment's output or (strict) over all of them."""
    if strict:
        return latest_rows(workers.drop("experiment_id"), ["worker_id"], ["timestamp"])
    return latest_rows(workers, ["experiment_id", "worker_id"], ["timestamp"])
