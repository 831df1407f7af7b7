from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawl_analytics.functions import times, urls
from crawl_analytics.plans import metrics, models, reports

REQ = (
    "experiment_id string, request_id string, worker_id string, crawl_session_id string, timestamp string, "
    "crawled_url string, url string, resource_type string, crawl_depth bigint, blocked_by string"
)


@pytest.fixture(scope="module")
def tables(spark):
    metadata = spark.createDataFrame(
        [("e1", (True, True, "chromium", False)), ("e2", (True, False, "firefox", False)), ("none", (False, True, "webkit", True))],
        "exp_id string, params struct<navigate_subpages: boolean, auto_accept_cookies: boolean, browser_type: string, headless: boolean>",
    )
    requests = spark.createDataFrame(
        [
            ("e1", "r1", "w1", "s1", "1", "https://www.a.de/x?q", "https://t.com/p", "script", 0, '["l"]'),
            ("e1", "r2", "w1", "s1", "2", "https://www.a.de/x?q", "https://u.com/p", "script", 1, None),
            ("e2", "r1", "w2", "s2", "3", "https://www.a.de/x?q", "https://t.com/p", "image", None, "[]"),
            ("e2", None, None, None, "4", "https://b.uk", "https://b.uk", "document", 0, "[]"),
        ],
        REQ,
    )
    workers = spark.createDataFrame(
        [(e, "w1", c, True, t) for e in ("e1", "e2") for c, t in (("XX", 1.0), ("DE", 2.0))],
        "experiment_id string, worker_id string, country_code string, is_residential boolean, timestamp double",
    )
    responses = spark.createDataFrame(
        [("e1", "s1", "r1", 200), ("e2", "s2", "r1", 404)],
        "experiment_id string, crawl_session_id string, request_id string, status bigint",
    )
    sites = spark.createDataFrame(
        [("e1", "s1", "1"), ("e2", "s1", "2")], "experiment_id string, crawl_session_id string, timestamp string"
    )
    consents = spark.createDataFrame([("e1", "s1"), ("e1", "s1")], "experiment_id string, crawl_session_id string")
    return [metadata, requests, workers, responses, sites, consents]


def test_reference_keys_multiply_rows(tables):
    rows = models.site_summary(*tables).collect()
    # r1 of e1: 4 worker rows x 2 responses x 2 site rows; r2: 4 x 2; r1 of e2: 2 responses; the NULL row; the empty experiment
    assert len(rows) == 16 + 8 + 2 + 1 + 1
    assert {r.worker_clicked_banner for r in rows if r.experiment_id == "e1"} == {True}
    empty = next(r for r in rows if r.experiment_id == "none")
    assert (empty.request_page_type, empty.request_is_tracker, empty.worker_clicked_banner) == ("Subpage", False, False)


def test_strict_keys_give_one_row_per_request(tables):
    rows = models.site_summary(*tables, keys="strict").collect()
    assert len(rows) == 5
    first = next(r for r in rows if r.request_is_tracker)
    assert (first.worker_country_code, first.response_status, first.seed_domain) == ("DE", 200, "a.de")
    assert [r.request_is_tracker for r in rows if r.request_blocked_by is None] == [False, False]


def test_unknown_key_mode_is_an_error(tables):
    with pytest.raises(ValueError):
        models.site_summary(*tables, keys="loose")


def test_enriched_classes(spark, tables):
    weighted = models.site_summary_weighted(*tables)
    tranco = spark.createDataFrame([(1000, "a.de")], "tranco_rank int, domain string")
    regions = spark.createDataFrame(
        [("de", "Europe", "W", True), ("uk", "Europe", "N", False)], "tld_key string, continent string, subregion string, is_eu boolean"
    )
    rows = models.site_summary_enriched(weighted, tranco, regions).collect()
    classes = {(r.request_base_url, r.request_requested_domain): r for r in rows}
    both = classes[("https://www.a.de/x", "t.com")]
    assert (both.cookie_request_class, both.min_depth, both.browser_signature) == ("regardless (both)", 0, "chromium + firefox")
    assert (both.seed_rank_bucket, both.website_legal_zone) == ("1. Top 1K", "EU (GDPR)")
    assert classes[("https://www.a.de/x", "u.com")].cookie_request_class == "only when cookies accepted"
    uk = classes[("https://b.uk", "b.uk")]
    assert (uk.cookie_request_class, uk.website_legal_zone, uk.seed_rank_bucket) == (
        "only when cookies not accepted",
        "UK (Post-Brexit GDPR)",
        "5. Unknown/Unranked",
    )
    # NULL keys do not match a signature
    assert classes[(None, None)].cookie_request_class is None


def test_no_flag_is_unclassified(spark):
    base = spark.createDataFrame(
        [("u", "d", None, None, None)],
        "request_base_url string, request_requested_domain string, experiment_auto_accept_cookies boolean, "
        "request_crawl_depth_int int, experiment_browser_type string",
    )
    row = models.request_signatures(base).first()
    assert (row.cookie_request_class, row.min_depth, row.browser_signature) == ("unclassified", None, "")


def test_weighted_view_equals_repeated_rows(spark, tables):
    tranco = spark.createDataFrame([(20000, "a.de")], "tranco_rank int, domain string")
    regions = spark.createDataFrame([], "tld_key string, continent string, subregion string, is_eu boolean")
    weighted = models.site_summary_enriched(models.site_summary_weighted(*tables), tranco, regions)
    repeated = models.repeat_rows(weighted, "copies")
    measures = ["total_network_requests", "total_trackers_loaded", "total_seed_domains", "unique_domains_contacted"]
    for dims in (["experiment_id"], ["seed_rank_bucket", "request_is_tracker"], []):
        a = metrics.site_summary_view(weighted).query(dims, measures).collect()
        b = metrics.site_summary_view(repeated).query(dims, measures).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_approximate_domains_are_near(spark):
    enriched = spark.range(20000).select(
        F.concat(F.lit("d"), F.col("id") % 5000).alias("request_requested_domain"), F.lit("s").alias("seed_domain"), F.lit(False).alias("request_is_tracker")
    )
    n = metrics.site_summary_view(enriched).query([], ["unique_domains_contacted"]).first()[0]
    assert abs(n - 5000) < 5000 * 0.08


def test_view_refuses_unknown_names_and_fine_grains(spark):
    progress = spark.createDataFrame([("e", datetime(2024, 1, 1), 1)], "experiment_id string, scraped_at timestamp_ntz, sites_completed bigint")
    view = metrics.crawl_progress_view(progress)
    with pytest.raises(KeyError):
        view.query(["nope"], ["sites_completed"])
    with pytest.raises(KeyError):
        view.query([], ["nope"])
    with pytest.raises(ValueError):
        view.timeseries("second", [], ["sites_completed"])
    with pytest.raises(ValueError):
        view.timeseries("hour", [], ["sites_completed"], "Mars/Base")


def test_view_titles_cover_all_names(spark):
    frame = spark.createDataFrame([], ", ".join(f"{d} string" for d in metrics.SITE_DIMENSIONS) + ", seed_domain string")
    view = metrics.site_summary_view(frame)
    assert len(view.dimensions) == 20 and len(view.measures) == 4
    assert set(view.dimensions) | set(view.measures) <= set(view.labels)


def test_wall_clock_knows_daylight_saving(spark):
    frame = spark.createDataFrame([("1704067207.179575",), ("1719835200",), ("bad",), (None,)], "t string")
    got = [r[0] for r in frame.select(times.wall_clock(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 1, 1, 0, 7, 179575), datetime(2024, 7, 1, 14, 0), None, None]


def test_times_do_not_depend_on_the_session_zone(spark):
    frame = spark.createDataFrame([("1711846800.5",)], "t string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = frame.select(times.wall_clock(F.col("t")).alias("w"), times.micros_of(times.wall_clock(F.col("t"), "UTC")).alias("u")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.w == datetime(2024, 3, 31, 3, 0, 0, 500000)
    assert row.u == 1711846800500000


def test_domains(spark):
    cases = {
        "https://www.a.de/x": "a.de",
        "http://user@b.org:80/": "b.org",
        "c.com": "c.com",
        "https://sub.www.d.com?x": "sub.www.d.com?x",
        "": "",
    }
    frame = spark.createDataFrame([(c,) for c in cases], "u string")
    assert {r.u: r.d for r in frame.select("u", urls.domain(F.col("u")).alias("d")).collect()} == cases


# -- reports ---------------------------------------------------------------------------------------


def main_rows(spark):
    rows = []

    def seed(name, status, ok=0, experiment="e1"):
        rows.append((experiment, name, name, status))
        rows.extend((experiment, name, f"{name}/{i}", 200) for i in range(ok))

    seed("loaded", 204)
    seed("redirect-loaded", 301, ok=1)
    seed("redirect-empty", 302)
    seed("forbidden", 403, ok=5)
    seed("forbidden-loaded", 403, ok=6)
    seed("missing", 404)
    seed("broken", 503)
    rows.append(("e1", "other", "elsewhere", 200))
    seed("best", 500)
    seed("best", 200, experiment="firefox_e2")
    seed("forbidden", 403, experiment="firefox_e2")
    return spark.createDataFrame(rows, "experiment_id string, crawled_url string, url string, status bigint")


def test_outcome_classes(spark):
    rows = reports.outcome_class(reports.outcome_flags(main_rows(spark))).collect()
    assert {r.crawled_url: r.category for r in rows} == {
        "loaded": "Loaded",
        "redirect-loaded": "Loaded",
        "redirect-empty": "Redirect (no content)",
        "forbidden": "Blocked (403)",
        "forbidden-loaded": "Loaded",
        "missing": "Client Error (4xx)",
        "broken": "Server Error (5xx)",
        "other": "Other",
        "best": "Loaded",
    }


def test_outcomes_sum_to_the_seeds(spark):
    rows = reports.with_no_response(reports.crawl_outcomes(main_rows(spark)), 20).collect()
    assert sum(r.sites for r in rows) == 20
    assert {r.category: r.sites for r in rows}["No Response"] == 11
    table = reports.outcome_chart_table(reports.with_no_response(reports.crawl_outcomes(main_rows(spark)), 25000)).collect()
    assert table[0].legend_label == "No Response\n24,991 sites (100%)"
    assert table[-1].chart_label == ""


def test_blocked_sites(spark):
    rows = {(r.experiment_id, r.crawled_url) for r in reports.blocked_sites(main_rows(spark)).collect()}
    assert rows == {("e1", "forbidden"), ("firefox_e2", "forbidden")}
    overall = reports.bot_detection_overall(main_rows(spark)).first()
    assert (overall.total, overall.blocked) == (8, 1)
    browsers = {r.browser: (r.total, r.blocked) for r in reports.bot_detection_by_browser(main_rows(spark)).collect()}
    assert browsers == {"Chromium": (8, 1), "Firefox": (2, 1)}


def test_hop_agreement_below_the_seed(spark):
    rows = [
        (e, f"{e}-s", depth, page, "document")
        for e in ("a", "b")
        for depth, page in ((0, "root"), (1, "shared"), (2, f"only-{e}"))
    ] + [("a", "a-t", 0, "lonely", "document"), ("a", "a-s", 1, "img", "image")]
    requests = spark.createDataFrame(rows, "experiment_id string, crawl_session_id string, crawl_depth bigint, crawled_url string, resource_type string")
    sites = requests.select("experiment_id", "crawl_session_id").distinct()
    got = [tuple(r) for r in reports.hop_agreement(requests, sites).collect()]
    assert got == [(0, 1, 1, 100.0), (1, 1, 1, 100.0), (2, 2, 0, 0.0)]


def test_progress_trend_is_a_straight_line(spark):
    rows = [("E", float(h), 10 * h + 5) for h in range(10)] + [("E", 20.0, 1000)]
    hours = spark.createDataFrame(rows, "experiment string, hours_elapsed double, sites_completed bigint")
    got = [(r[0], round(r[1], 6)) for r in reports.progress_trend(hours, "E", 9.0).collect()]
    assert got == [(9.0, 95.0), (23.0, 235.0)]
