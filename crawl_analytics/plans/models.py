"""Models: crawl progress, site summary and its enriched form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    COOKIES_ACCEPTED,
    COOKIES_BOTH,
    COOKIES_NOT_ACCEPTED,
    COOKIES_UNCLASSIFIED,
    RANK_BEYOND,
    RANK_BUCKETS,
    RANK_UNKNOWN,
    ZONE_CH,
    ZONE_EU,
    ZONE_GENERIC,
    ZONE_OTHER_CCTLD,
    ZONE_UK,
)
from ..functions import times, urls
from ..operators.enrich import dedup_workers
from ..operators.joins import first_rows, hot_buckets, lookup_join, repeat_rows, salted_join
from ..operators.ranking import running_number
from ..session import new_run_dir
from ..sources.lake import materialize

KEY_MODES = ("reference", "strict")


def session_starts(requests: DataFrame, keys: str = "reference") -> DataFrame:
    """First request of every session as (experiment_id, crawl_session_id, scraped_at).

    Text order of the timestamp decides. Strict mode keeps sessions of different
    experiments apart.
    """
    by = ["crawl_session_id"] if keys == "reference" else ["experiment_id", "crawl_session_id"]
    first = first_rows(requests.select("experiment_id", "crawl_session_id", "timestamp"), by, ["timestamp"])
    return first.select(
        "experiment_id",
        "crawl_session_id",
        times.wall_clock(F.col("timestamp")).alias("scraped_at"),
    )


def crawl_progress(requests: DataFrame, keys: str = "reference") -> DataFrame:
    """Running number of completed sites per experiment, by the wall clock of the session start.

    The session starts, one row per session, are read three times and therefore
    stored in the shared folder.
    """
    starts = session_starts(requests, keys).withColumn("wall_us", times.micros_of(F.col("scraped_at")))
    starts = materialize(starts, new_run_dir(requests.sparkSession, "session-starts"))
    numbered = running_number(starts, ["experiment_id"], "wall_us", ["crawl_session_id"], "sites_completed")
    return numbered.select("experiment_id", "scraped_at", "sites_completed")


def _with_copies(rows: DataFrame, into: str) -> DataFrame:
    """Equal rows reduced to one with their number."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(into))


def site_summary_weighted(
    metadata: DataFrame,
    requests: DataFrame,
    workers: DataFrame,
    responses: DataFrame,
    site_metadata: DataFrame,
    consents: DataFrame,
    keys: str = "reference",
) -> DataFrame:
    """The site summary with equal joined rows counted in ``copies`` instead of repeated.

    ``metadata`` has exp_id and params. In reference mode workers join on their id,
    responses on the request id and site metadata on the session, each over all
    experiments; strict mode adds the experiment (and session), takes the latest
    worker row and leaves the site metadata out, which adds no column. The right
    sides are counted down before the joins, so repeats there cost nothing in them.
    """
    if keys not in KEY_MODES:
        raise ValueError(f"keys must be one of {KEY_MODES}")
    strict = keys == "strict"
    req = requests.select(
        "experiment_id", "request_id", "worker_id", "crawl_session_id", "crawled_url", "url", "resource_type", "crawl_depth", "blocked_by"
    )
    if strict:
        wm = dedup_workers(workers, strict=True).select("worker_id", "country_code", "is_residential").withColumn("wm_n", F.lit(1))
        res_on = ["experiment_id", "crawl_session_id", "request_id"]
        res = first_rows(responses.select(*res_on, "status"), res_on, ["status"]).withColumn("res_n", F.lit(1))
        session = ["experiment_id", "crawl_session_id"]
    else:
        wm = _with_copies(workers.select("worker_id", "country_code", "is_residential"), "wm_n")
        res_on = ["request_id"]
        res = _with_copies(responses.select("request_id", "status"), "res_n")
        session = ["crawl_session_id"]
    marks = consents.select(*session, F.lit(None).cast("int").alias("sm"), F.lit(True).alias("ck"))
    if not strict:
        # both session tables meet the requests in one join
        left = site_metadata.select(*session, F.lit(1).alias("sm"), F.lit(None).cast("boolean").alias("ck"))
        marks = marks.unionByName(left)
    sessions = marks.groupBy(*session).agg(F.count("sm").alias("sm_n"), F.max("ck").alias("clicked"))

    joined = lookup_join(req, wm, ["worker_id"], hot_rows=req)
    hot_res, hot_sessions = hot_buckets(req, [res_on, session])
    joined = salted_join(joined, res, res_on, hot=hot_res)
    joined = salted_join(joined, sessions, session, hot=hot_sessions)

    meta = metadata.select(
        F.col("exp_id").alias("experiment_id"),
        F.col("params.navigate_subpages").alias("experiment_navigate_subpages"),
        F.col("params.auto_accept_cookies").alias("experiment_auto_accept_cookies"),
        F.col("params.browser_type").alias("experiment_browser_type"),
        F.col("params.headless").alias("experiment_headless"),
    )
    inside = lookup_join(joined, meta, ["experiment_id"], "inner", hot_rows=req)
    empty = meta.join(req.select("experiment_id").distinct(), "experiment_id", "left_anti")
    rows = inside.unionByName(empty, allowMissingColumns=True)
    one = F.lit(1).cast("bigint")
    copies = one
    for n in ("wm_n", "res_n", "sm_n"):
        copies = copies * F.greatest(F.coalesce(F.col(n).cast("bigint"), one), one)
    return rows.select(
        "experiment_id",
        "experiment_navigate_subpages",
        "experiment_auto_accept_cookies",
        "experiment_browser_type",
        "experiment_headless",
        F.col("country_code").alias("worker_country_code"),
        F.col("is_residential").alias("worker_is_residential"),
        F.col("status").alias("response_status"),
        F.col("resource_type").alias("request_resource_type"),
        F.col("crawled_url").alias("request_crawled_url"),
        urls.domain(F.col("crawled_url")).alias("seed_domain"),
        urls.domain(F.col("url")).alias("request_requested_domain"),
        F.col("crawl_depth").alias("request_crawl_depth"),
        F.when(F.col("crawl_depth") == 0, F.lit("Homepage")).otherwise(F.lit("Subpage")).alias("request_page_type"),
        F.col("blocked_by").alias("request_blocked_by"),
        F.coalesce(F.col("blocked_by") != "[]", F.lit(False)).alias("request_is_tracker"),
        F.col("clicked").isNotNull().alias("worker_clicked_banner"),
        copies.alias("copies"),
    )


def site_summary(*tables: DataFrame, keys: str = "reference") -> DataFrame:
    """One row per request with everything known about it (see ``site_summary_weighted``)."""
    return repeat_rows(site_summary_weighted(*tables, keys=keys), "copies")


def summary_base(summary: DataFrame) -> DataFrame:
    """Adds top-level domain, integer depth and URL without query."""
    return summary.select(
        "*",
        urls.tld(F.col("seed_domain")).alias("website_tld"),
        F.col("request_crawl_depth").cast("int").alias("request_crawl_depth_int"),
        urls.base_url(F.col("request_crawled_url")).alias("request_base_url"),
    )


def request_signatures(base: DataFrame) -> DataFrame:
    """Cookie behaviour, least depth and browsers per (seed URL without query, requested domain)."""
    seen = base.groupBy(F.col("request_base_url").alias("sig_url"), F.col("request_requested_domain").alias("sig_domain")).agg(
        F.bool_or("experiment_auto_accept_cookies").alias("yes"),
        F.bool_or(~F.col("experiment_auto_accept_cookies")).alias("no"),
        F.min("request_crawl_depth_int").alias("min_depth"),
        F.array_join(F.sort_array(F.collect_set("experiment_browser_type")), " + ").alias("browser_signature"),
    )
    yes, no = F.col("yes"), F.col("no")
    kind = (
        F.when(yes & no, F.lit(COOKIES_BOTH))
        .when(yes & ~no, F.lit(COOKIES_ACCEPTED))
        .when(~yes & no, F.lit(COOKIES_NOT_ACCEPTED))
        .otherwise(F.lit(COOKIES_UNCLASSIFIED))
    )
    return seen.select("sig_url", "sig_domain", kind.alias("cookie_request_class"), "min_depth", "browser_signature")


def rank_bucket(rank: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for limit, label in RANK_BUCKETS:
        out = out.when(rank <= limit, F.lit(label))
    return out.when(rank.isNotNull(), F.lit(RANK_BEYOND)).otherwise(F.lit(RANK_UNKNOWN))


def add_rank(rows: DataFrame, tranco: DataFrame, hot_rows: DataFrame | None = None) -> DataFrame:
    """Adds the seed's rank and its bucket; a domain listed twice repeats the row."""
    ranks = tranco.select(F.col("domain").alias("seed_domain"), F.col("tranco_rank").alias("seed_website_rank"))
    out = lookup_join(rows, ranks, ["seed_domain"], hot_rows=hot_rows)
    return out.select(*rows.columns, "seed_website_rank", rank_bucket(F.col("seed_website_rank")).alias("seed_rank_bucket"))


def add_region(rows: DataFrame, regions: DataFrame, hot_rows: DataFrame | None = None) -> DataFrame:
    """Adds continent and legal zone of the seed's top-level domain."""
    known = regions.select(F.col("tld_key").alias("website_tld"), "continent", "is_eu")
    out = lookup_join(rows, known, ["website_tld"], hot_rows=hot_rows)
    code = F.col("website_tld")
    zone = (
        F.when(F.col("is_eu"), F.lit(ZONE_EU))
        .when(code == "uk", F.lit(ZONE_UK))
        .when(code == "ch", F.lit(ZONE_CH))
        .when((F.length(code) == 2) & F.col("continent").isNotNull(), F.lit(ZONE_OTHER_CCTLD))
        .otherwise(F.lit(ZONE_GENERIC))
    )
    return out.select(
        *rows.columns, F.coalesce("continent", F.lit(ZONE_GENERIC)).alias("website_continent"), zone.alias("website_legal_zone")
    )


def site_summary_enriched(summary: DataFrame, tranco: DataFrame, regions: DataFrame) -> DataFrame:
    """Site summary with rank, region and request signature. A ``copies`` column is carried along."""
    base = summary_base(summary)
    signed = request_signatures(base).select(
        F.col("sig_url").alias("request_base_url"),
        F.col("sig_domain").alias("request_requested_domain"),
        "cookie_request_class",
        "min_depth",
        "browser_signature",
    )
    ranked = add_rank(base, tranco, hot_rows=base)
    placed = add_region(ranked, regions, hot_rows=base)
    on = ["request_base_url", "request_requested_domain"]
    out = salted_join(placed, signed, on, hot=hot_buckets(base, [on])[0])
    return out.select(*placed.columns, "cookie_request_class", "min_depth", "browser_signature")
