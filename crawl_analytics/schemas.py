"""Explicit schemas of every table. Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.jsontext import float_text

REQUESTS = (
    "experiment_id string, request_id string, worker_id string, crawl_session_id string, "
    "crawled_url string, current_page_url string, url string, frame_url string, "
    "resource_type string, method string, headers string, timestamp string, crawl_depth bigint"
)
RESPONSES = (
    "experiment_id string, request_id string, crawl_session_id string, crawled_url string, "
    "url string, status bigint, headers string, timestamp string, cookies string, crawl_depth bigint"
)
CONSENTS = (
    "experiment_id string, crawl_session_id string, crawled_url string, url string, "
    "timestamp string, crawl_depth bigint"
)
SITE_METADATA = "experiment_id string, crawl_session_id string, timestamp string, description string"
WORKER_METADATA = (
    "experiment_id string, worker_id string, country_code string, is_residential boolean, timestamp double"
)
PARAMS = (
    "struct<auto_accept_cookies: boolean, navigate_subpages: boolean, max_depth: int, dwell_time: int, "
    "scroll_amounts: array<bigint>, browser_type: string, headless: boolean>"
)
METADATA = f"id string, timestamp timestamp, total_urls bigint, params {PARAMS}"
TRANCO = "tranco_rank int, domain string"
COUNTRIES = "tld string, region string, subregion string, cca2 string"
IP_REPORT = (
    "ip string, location struct<country_code: string>, "
    "risk struct<is_vpn: boolean, is_proxy: boolean, is_datacenter: boolean>"
)

BY_DATA_TYPE = {
    "requests": REQUESTS,
    "responses": RESPONSES,
    "cookie_warning_consents": CONSENTS,
    "site_metadata": SITE_METADATA,
    "worker_metadata": WORKER_METADATA,
}


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def _as_kind(name: str, found: str | None, kind: str) -> Column:
    if found is None:
        return F.lit(None).cast(kind).alias(name)
    if found == kind:
        return F.col(name)
    if kind == "string" and found in ("double", "float"):
        return float_text(F.col(name)).alias(name)
    return F.col(name).try_cast(kind).alias(name)


def conform(rows: DataFrame, ddl: str) -> DataFrame:
    """Cast columns by name, add missing ones as typed NULL and keep extra ones at the end.

    Numbers become plain decimal text where text is wanted; text that is no number becomes NULL where a number is.
    """
    wanted = columns(ddl)
    found = dict(rows.dtypes)
    out = [_as_kind(name, found.get(name), kind) for name, kind in wanted]
    names = {name for name, _ in wanted}
    return rows.select(*out, *[c for c in rows.columns if c not in names])
