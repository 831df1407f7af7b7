"""The registered queries: every operator over the fixture tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import FILTER_LISTS, Fixture
from .functions import times
from .functions.hosts import canonical_host, registrable_domain
from .functions.urls import normalize_url
from .operators import enrich, pages, status, tasks, workers
from .operators.labelling import label_requests
from .operators.rules import parse_rules
from .plans import metrics, models, reports
from .plans.cube import build_cube
from .plans.enrichment import enrich as enrich_lake
from .plans.enrichment import enriched_tables
from .plans.increment import enrich_increment as increment
from .schemas import REQUESTS, conform
from .session import new_run_dir
from .sources import lake, lists
from .streaming import commits, compaction, events, jobs, sessions

TITLES = {
    "chromiumnocookies_e0": "Chromium, consent refused",
    "firefoxwithcookies_e1": "Firefox, consent given",
    "chromiumwithcookies_e2": "Chromium, consent given",
}
TREND_CUTOFF_HOURS = 300.0
SEED_TOTAL = 200
ZONE = "America/New_York"
PARAMS = {"max_depth": 2, "dwell_time": 5, "scroll_amounts": [500, 250], "browser_type": "firefox", "headless": True}

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Fixture(spark, sf_dir))

    run.__doc__ = build.__doc__
    run.__name__ = build.__name__
    _REGISTRY[build.__name__] = run
    return build


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


# -- shared steps ----------------------------------------------------------------------------------


def _raw_requests(fx: Fixture) -> DataFrame:
    return fx["raw_requests"].drop("k")


def _stored(fx: Fixture, name: str, rows: DataFrame) -> DataFrame:
    """A step that is read several times, written once. A persisted frame is
    computed again where it meets a frame of the same origin in a join."""
    return lake.materialize(rows, new_run_dir(fx.spark, name))


def _kept(fx: Fixture) -> DataFrame:
    # one row per seed, needed by every table that is cleaned
    if "kept" not in fx.steps:
        fx.steps["kept"] = _stored(fx, "kept", enrich.kept_sessions(_raw_requests(fx)))
    return fx.steps["kept"]


def _requests(fx: Fixture) -> DataFrame:
    return enrich.dedup_requests(_raw_requests(fx), _kept(fx))


def _responses(fx: Fixture) -> DataFrame:
    return enrich.dedup_responses(fx["raw_responses"], _kept(fx))


def _consents(fx: Fixture) -> DataFrame:
    return enrich.dedup_consents(fx["raw_consents"], _kept(fx))


def _sites(fx: Fixture) -> DataFrame:
    return enrich.dedup_site_metadata(fx["raw_site_metadata"], _kept(fx))


def _workers(fx: Fixture) -> DataFrame:
    return enrich.dedup_workers(fx["raw_worker_metadata"])


def _rules(fx: Fixture) -> DataFrame:
    rows = [f"({i}, '{name}', '{line}')" for i, (name, text) in enumerate(FILTER_LISTS.items()) for line in text]
    return parse_rules(fx.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(list_ord, list_name, line)")).persist()


def _labeled(fx: Fixture) -> DataFrame:
    # requests are read for the distinct triples and for the join back
    return label_requests(_stored(fx, "single", _requests(fx)), _rules(fx))


def _metadata(fx: Fixture) -> DataFrame:
    flat = ["navigate_subpages", "auto_accept_cookies", "browser_type", "headless"]
    return fx["metadata"].select("exp_id", "total_urls", F.struct(*flat).alias("params"))


def _model_tables(fx: Fixture) -> list[DataFrame]:
    # the model joins read the labelled requests several times
    labeled = _stored(fx, "labeled", lake.read_requests(_labeled(fx)))
    return [_metadata(fx), labeled, _stored(fx, "workers", _workers(fx)), _responses(fx), _sites(fx), _consents(fx)]


def _weighted(fx: Fixture) -> DataFrame:
    return models.site_summary_weighted(*_model_tables(fx))


def _enriched_weighted(fx: Fixture) -> DataFrame:
    return models.site_summary_enriched(_stored(fx, "summary", _weighted(fx)), fx["tranco"], _regions(fx))


def _regions(fx: Fixture) -> DataFrame:
    return lists.region_catalog(fx["countries"])


def _main(fx: Fixture) -> DataFrame:
    # the reports read the narrow rows up to three times
    return _stored(fx, "main", reports.main_documents(_responses(fx)))


def _report_requests(fx: Fixture) -> DataFrame:
    columns = ["experiment_id", "crawl_session_id", "crawled_url", "crawl_depth", "resource_type"]
    return _stored(fx, "report-requests", _requests(fx).select(*columns))


def _sessions_with_site(fx: Fixture) -> DataFrame:
    return _stored(fx, "sites", _sites(fx).select("experiment_id", "crawl_session_id"))


def _progress(fx: Fixture) -> DataFrame:
    return _stored(fx, "progress", models.crawl_progress(_requests(fx)))


# -- enrichment ------------------------------------------------------------------------------------


@query
def session_counts(fx: Fixture) -> DataFrame:
    """Requests per session."""
    return enrich.session_counts(_raw_requests(fx))


@query
def kept_sessions(fx: Fixture) -> DataFrame:
    """The session kept per seed."""
    return enrich.kept_sessions(_raw_requests(fx))


@query
def dedup_requests(fx: Fixture) -> DataFrame:
    """One request per seed and URL."""
    return _requests(fx)


@query
def dedup_responses(fx: Fixture) -> DataFrame:
    """One response per seed and URL."""
    return _responses(fx)


@query
def dedup_consents(fx: Fixture) -> DataFrame:
    """One consent per seed."""
    return _consents(fx)


@query
def dedup_site_metadata(fx: Fixture) -> DataFrame:
    """Site metadata of kept sessions."""
    return _sites(fx)


@query
def dedup_workers(fx: Fixture) -> DataFrame:
    """One row per worker and experiment."""
    return _workers(fx)


@query
def labeled_requests(fx: Fixture) -> DataFrame:
    """Requests with the lists that block them."""
    return _labeled(fx)


@query
def labeled_requests_by_site_rules(fx: Fixture) -> DataFrame:
    """A list whose rules come from the pages: hosts, exact URLs, exceptions, parties."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    kind = F.col("page_id") % 5
    line = (
        F.when(kind == 0, F.concat(F.lit("||"), host, F.lit("^$third-party")))
        .when(kind == 1, F.concat(F.lit("|"), F.col("url"), F.lit("|")))
        .when(kind == 2, F.concat(F.lit("@@||"), host, F.lit("^$image")))
        .when(kind == 3, F.concat(F.lit("||"), host, F.lit("^$script,important")))
        .otherwise(F.concat(F.lit("||"), host, F.lit("##.banner")))
    )
    rules = parse_rules(fx["seeds"].select(F.lit(0).alias("list_ord"), F.lit("sites").alias("list_name"), line.alias("line")))
    requests = _stored(fx, "asked", _raw_requests(fx).select("experiment_id", "request_id", "url", "frame_url", "resource_type"))
    return label_requests(requests, _stored(fx, "site-rules", rules))


@query
def label_keyless_rules(fx: Fixture) -> DataFrame:
    """Thousands of rules without a host or a whole word: three and four characters from inside the pages' words."""
    cut = lambda text, pattern: F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word")
    kind = (F.col("page_id") % 4).alias("kind")
    words = fx.source("pages").select(kind, cut("html", "[a-z]{6,9}")).union(fx["seeds"].select(kind, cut("url", "[a-z]{5,9}"))).distinct()
    sized = words.withColumn("n", F.explode(F.array(F.lit(3), F.lit(4))))
    piece = F.substr("word", F.lit(2), F.col("n")).alias("piece")
    line = (
        F.when(F.col("kind") == 0, F.col("piece"))
        .when(F.col("kind") == 1, F.concat("piece", F.lit("$script")))
        .when(F.col("kind") == 2, F.concat(F.lit("@@"), "piece", F.lit("$image")))
        .otherwise(F.concat("piece", F.lit("$xhr")))
    )
    lines = sized.select("kind", piece).distinct().select(F.lit(0).alias("list_ord"), F.lit("pieces").alias("list_name"), line.alias("line"))
    everything = fx.spark.range(1).select(F.lit(1).alias("list_ord"), F.lit("types").alias("list_name"), F.lit("*$image").alias("line"))
    requests = _stored(fx, "asked", _raw_requests(fx).select("experiment_id", "request_id", "url", "frame_url", "resource_type"))
    return label_requests(requests, _stored(fx, "piece-rules", parse_rules(lines.unionByName(everything))))


# -- models ----------------------------------------------------------------------------------------


@query
def session_starts(fx: Fixture) -> DataFrame:
    """M1: first request per session."""
    return models.session_starts(_requests(fx)).select("experiment_id", "crawl_session_id", "scraped_at")


@query
def crawl_progress(fx: Fixture) -> DataFrame:
    """M2: running count per experiment."""
    return _progress(fx)


@query
def site_summary(fx: Fixture) -> DataFrame:
    """M3, M3a-M3f with the reference keys."""
    return models.site_summary(*_model_tables(fx))


@query
def site_summary_strict(fx: Fixture) -> DataFrame:
    """M3 with strict keys."""
    return models.site_summary(*_model_tables(fx), keys="strict")


@query
def request_signatures(fx: Fixture) -> DataFrame:
    """M4-M7: behaviour class, least depth, browsers per seed URL and domain."""
    return models.request_signatures(models.summary_base(_weighted(fx)))


@query
def site_summary_enriched(fx: Fixture) -> DataFrame:
    """The enriched site summary."""
    return models.repeat_rows(_enriched_weighted(fx), "copies")


@query
def rank_buckets(fx: Fixture) -> DataFrame:
    """M8: requests per rank bucket of their seed."""
    seeds = _requests(fx).select(models.urls.domain(F.col("crawled_url")).alias("seed_domain"))
    return models.add_rank(seeds, fx["tranco"]).groupBy("seed_rank_bucket").agg(F.count(F.lit(1)).alias("n"))


@query
def legal_zones(fx: Fixture) -> DataFrame:
    """Requests per continent and legal zone of their seed."""
    seeds = _requests(fx).select(models.urls.tld(models.urls.domain(F.col("crawled_url"))).alias("website_tld"))
    zones = models.add_region(seeds, _regions(fx))
    return zones.groupBy("website_continent", "website_legal_zone").agg(F.count(F.lit(1)).alias("n"))


@query
def region_catalog(fx: Fixture) -> DataFrame:
    """One row per top-level domain."""
    return _regions(fx)


# -- metrics ---------------------------------------------------------------------------------------

_EXACT = ["total_network_requests", "total_trackers_loaded", "total_seed_domains"]


@query
def metrics_by_tracker(fx: Fixture) -> DataFrame:
    """Measures by tracker flag and page type."""
    return metrics.site_summary_view(_enriched_weighted(fx)).query(["request_is_tracker", "request_page_type"], _EXACT)


@query
def metrics_by_zone(fx: Fixture) -> DataFrame:
    """Measures by legal zone and behaviour class, for one resource type."""
    view = metrics.site_summary_view(_enriched_weighted(fx)).where("request_resource_type = 'script'")
    return view.query(["website_legal_zone", "cookie_request_class", "seed_rank_bucket"], _EXACT)


@query
def metrics_approx_domains(fx: Fixture) -> DataFrame:
    """Approximate distinct domains by experiment; the sketch decides the last digits."""
    return metrics.site_summary_view(_enriched_weighted(fx)).query(["experiment_id"], ["unique_domains_contacted"])


@query
def metrics_timeseries(fx: Fixture) -> DataFrame:
    """G3e, G4, G9: progress per hour in another time zone."""
    view = metrics.crawl_progress_view(_progress(fx))
    return view.timeseries("hour", ["experiment_id"], ["sites_completed"], ZONE)


@query
def metrics_compare(fx: Fixture) -> DataFrame:
    """The last 24 hours against the 24 before, per experiment."""
    return metrics.crawl_progress_view(_progress(fx)).compare(24, ["experiment_id"], ["sites_completed"])


@query
def metrics_last_day(fx: Fixture) -> DataFrame:
    """The last 24 hours."""
    return metrics.crawl_progress_view(_progress(fx)).last(24).query(["experiment_id"], ["sites_completed"])


@query
def metrics_top20(fx: Fixture) -> DataFrame:
    """The twenty seeds with most traffic."""
    view = metrics.site_summary_view(_enriched_weighted(fx))
    return view.query(["request_crawled_url"], ["total_network_requests"], sort="total_network_requests", limit=20)


# -- reports ---------------------------------------------------------------------------------------


@query
def blocked_sites(fx: Fixture) -> DataFrame:
    """Seeds that were refused."""
    return reports.blocked_sites(_main(fx)).select("experiment_id", "crawled_url")


@query
def bot_detection_by_browser(fx: Fixture) -> DataFrame:
    """R3, R5."""
    return reports.bot_detection_by_browser(_main(fx))


@query
def bot_detection_overall(fx: Fixture) -> DataFrame:
    """R4, R5."""
    return reports.bot_detection_overall(_main(fx))


@query
def successful_sessions(fx: Fixture) -> DataFrame:
    """R17c."""
    return reports.successful_sessions(_sites(fx))


@query
def cookie_warnings(fx: Fixture) -> DataFrame:
    """R6."""
    return reports.cookie_warnings(_report_requests(fx), _consents(fx), _sessions_with_site(fx))


@query
def cookie_warnings_share(fx: Fixture) -> DataFrame:
    """R7."""
    return reports.cookie_warnings_share(reports.cookie_warnings(_report_requests(fx), _consents(fx), _sessions_with_site(fx)))


@query
def outcome_flags(fx: Fixture) -> DataFrame:
    """R8."""
    return reports.outcome_flags(_main(fx))


@query
def crawl_outcomes(fx: Fixture) -> DataFrame:
    """Seeds per outcome."""
    return reports.crawl_outcomes(_main(fx))


@query
def crawl_outcomes_by_experiment(fx: Fixture) -> DataFrame:
    """R10."""
    return reports.crawl_outcomes_by_experiment(_main(fx))


@query
def outcomes_with_no_response(fx: Fixture) -> DataFrame:
    """R11."""
    return reports.with_no_response(reports.crawl_outcomes(_main(fx)), SEED_TOTAL)


@query
def outcomes_with_no_response_by_experiment(fx: Fixture) -> DataFrame:
    """R10, R11."""
    counts = reports.crawl_outcomes_by_experiment(_main(fx))
    return reports.with_no_response(counts, SEED_TOTAL, ["experiment_id"])


@query
def outcome_chart_table(fx: Fixture) -> DataFrame:
    """R12."""
    return reports.outcome_chart_table(reports.with_no_response(reports.crawl_outcomes(_main(fx)), SEED_TOTAL))


@query
def progress_hours(fx: Fixture) -> DataFrame:
    """R13."""
    hours = reports.progress_hours(_progress(fx), TITLES)
    return hours.withColumn("hours_elapsed", F.round("hours_elapsed", 6))


@query
def progress_trend(fx: Fixture) -> DataFrame:
    """R14."""
    hours = reports.progress_hours(_progress(fx), TITLES)
    trend = reports.progress_trend(hours, TITLES["chromiumwithcookies_e2"], TREND_CUTOFF_HOURS)
    return trend.select(*[F.round(c, 4).alias(c) for c in trend.columns])


@query
def experiment_overview(fx: Fixture) -> DataFrame:
    """R15."""
    return reports.experiment_overview(_labeled(fx), _responses(fx))


@query
def experiment_overview_long(fx: Fixture) -> DataFrame:
    """R16."""
    return reports.experiment_overview_long(reports.experiment_overview(_labeled(fx), _responses(fx)))


@query
def session_roots(fx: Fixture) -> DataFrame:
    """R17d."""
    return reports.session_roots(_requests(fx), _sites(fx))


@query
def hop_agreement(fx: Fixture) -> DataFrame:
    """R17."""
    return reports.hop_agreement(_report_requests(fx), _sessions_with_site(fx))


@query
def worker_distribution(fx: Fixture) -> DataFrame:
    """R18."""
    return reports.worker_distribution(_requests(fx), _workers(fx))


@query
def worker_distribution_top(fx: Fixture) -> DataFrame:
    """The first ten countries only."""
    return reports.worker_distribution(_requests(fx), _workers(fx), top=10)


# -- status, seeds, tasks --------------------------------------------------------------------------


def _documents(fx: Fixture) -> DataFrame:
    created = F.lit(datetime(2024, 1, 1, 12, 30))
    return fx["metadata"].select(F.col("exp_id").alias("id"), created.alias("timestamp"), "total_urls")


@query
def remaining(fx: Fixture) -> DataFrame:
    """U1."""
    return status.remaining(fx["queue_depths"], _documents(fx))


@query
def experiment_status(fx: Fixture) -> DataFrame:
    """U2, U3."""
    return status.status_table(status.experiment_status(_documents(fx), fx["queue_depths"]))


@query
def list_experiments(fx: Fixture) -> DataFrame:
    """S5."""
    return lake.list_experiments(fx["object_keys"])


@query
def top_seeds(fx: Fixture) -> DataFrame:
    """T1, T2."""
    return tasks.top_seeds(fx["tranco"], 40)


@query
def normalize_urls(fx: Fixture) -> DataFrame:
    """Page URLs with the scheme dropped, upper-cased or with a default port."""
    kind = F.col("page_id") % 3
    host = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    raw = (
        F.when(kind == 0, F.regexp_replace("url", "^[a-z]+://", ""))
        .when(kind == 1, F.regexp_replace("url", "^[a-z]+://[^/]+", "HTTP://WWW.Example.COM:80"))
        .otherwise(host)
    )
    return fx["seeds"].select("page_id", normalize_url(raw).alias("url"))


@query
def registrable_domains(fx: Fixture) -> DataFrame:
    """The registrable domain of page hosts below plain, wildcard and exception suffixes."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    name, kind = F.split_part(host, F.lit("."), F.lit(1)), F.col("page_id") % 8
    below = ["co.uk", "city.kobe.jp", "district.kobe.jp", "www.ck", "shop.ck", "github.io", "unknown.zz"]
    made = host
    for i, suffix in enumerate(below, 1):
        made = F.when(kind == i, F.concat(F.lit("www."), name, F.lit(f".{suffix}"))).otherwise(made)
    return fx["seeds"].select("page_id", made.alias("host")).withColumn("site", registrable_domain(F.col("host")))


@query
def canonical_hosts(fx: Fixture) -> DataFrame:
    """Hosts with capitals, international letters, numbers for addresses, IPv6, or none at all."""
    host, kind = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.col("page_id") % 6
    made = (
        F.when(kind == 0, F.upper(host))
        .when(kind == 1, F.concat(F.lit("B\u00fccher."), host, F.lit(".")))
        .when(kind == 2, F.concat(F.lit("0x7f."), F.col("page_id").cast("string")))
        .when(kind == 3, F.concat(F.lit("[2001:DB8:0:0:0:0:0:"), F.hex("page_id"), F.lit("]")))
        .when(kind == 4, F.concat(host, F.lit("..bad")))
        .otherwise((F.lit(3232235520) + F.col("page_id") % 256).cast("string"))
    )
    return fx["seeds"].select("page_id", made.alias("given")).withColumn("host", canonical_host(F.col("given")))


@query
def build_tasks(fx: Fixture) -> DataFrame:
    """T3, T4, T7."""
    seeds = fx["tranco"].select(normalize_url(F.col("domain")).alias("url"))
    return tasks.build_tasks(seeds, PARAMS, "exp_1").withColumn("scroll_amounts", F.to_json("scroll_amounts"))


@query
def task_lanes(fx: Fixture) -> DataFrame:
    """T5."""
    seeds = fx["seeds"].select("url", (F.col("page_id") % 2 == 0).alias("even"))
    first = tasks.build_tasks(seeds.filter("even"), PARAMS, "exp_1")
    second = tasks.build_tasks(seeds.filter("NOT even"), {"headless": True}, "exp_2")
    return tasks.lane(first.unionByName(second), "chromium", True).select("url", "experiment_id", "subject")


@query
def experiment_row(fx: Fixture) -> DataFrame:
    """T6."""
    row = tasks.build_experiment(fx["seeds"], PARAMS, "exp_1", datetime(2024, 1, 1))
    return row.select("id", "total_urls", "params.max_depth", "params.browser_type", "params.auto_accept_cookies")


# -- pages -----------------------------------------------------------------------------------------


def _raw_pages(fx: Fixture) -> DataFrame:
    return fx.source("pages")


def _site_links(fx: Fixture) -> DataFrame:
    return fx["site_links"].groupBy("url").agg(F.collect_set("link").alias("links"))


@query
def extract_links(fx: Fixture) -> DataFrame:
    """P1."""
    return pages.extract_links(_raw_pages(fx))


@query
def site_description(fx: Fixture) -> DataFrame:
    """P2."""
    return pages.site_description(fx["described_pages"])


@query
def choose_link(fx: Fixture) -> DataFrame:
    """The generator is Python's, so there is no SQL for it."""
    links = pages.link_sets(_raw_pages(fx))
    return links.select("page_id", pages.choose_link(F.col("links"), F.col("url"), F.lit(0)).alias("link"))


@query
def walk(fx: Fixture) -> DataFrame:
    """Needs P3, so there is no SQL for it."""
    starts = _raw_pages(fx).select(F.lit("exp_1").alias("experiment_id"), "url")
    return pages.walk(starts, _site_links(fx), 3)


@query
def match_consent(fx: Fixture) -> DataFrame:
    """P5, P5a, P5b."""
    return pages.match_consent(fx["consent_pages"])


# -- workers and events ----------------------------------------------------------------------------


@query
def classify_workers(fx: Fixture) -> DataFrame:
    """E10."""
    return workers.classify_workers(fx["ip_reports"])


@query
def residential_workers(fx: Fixture) -> DataFrame:
    """E11."""
    return workers.only_residential(workers.classify_workers(fx["ip_reports"])).select("worker_id", "country_code")


@query
def event_requests(fx: Fixture) -> DataFrame:
    """E1, E5, E6."""
    return events.route(events.to_requests(fx["browser_events"]))


@query
def event_requests_stamped(fx: Fixture) -> DataFrame:
    """E5: requests per worker after stamping them all with one id."""
    stamped = events.stamp_worker(events.to_requests(fx["browser_events"].drop("worker_id")), "w-1")
    return stamped.groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"))


@query
def event_responses(fx: Fixture) -> DataFrame:
    """E2."""
    return events.to_responses(fx["browser_events"])


@query
def event_consents(fx: Fixture) -> DataFrame:
    """E3."""
    return events.to_consents(fx["browser_events"])


@query
def event_site_metadata(fx: Fixture) -> DataFrame:
    """E4."""
    return events.to_site_metadata(fx["browser_events"])


def _finish(stream) -> None:
    stream.awaitTermination()


def _deliveries(fx: Fixture, rows: DataFrame, batches: int) -> DataFrame:
    """A stream of events that comes in so many micro-batches, each of a file per core at least, so that no task holds a batch."""
    source, files = new_run_dir(fx.spark, "events"), max(1, fx.spark.sparkContext.defaultParallelism)
    rows.repartition(batches * files).write.parquet(source)
    found = len(fx.spark.read.schema(rows.schema).parquet(source).inputFiles())
    stream = fx.spark.readStream.schema("experiment string, worker_id string, data_type string, event string")
    return stream.option("maxFilesPerTrigger", -(-found // batches)).parquet(source)


@query
def stream_event_sink(fx: Fixture) -> DataFrame:
    """Events streamed into the raw lake, read back and counted."""
    source, root, marks = (new_run_dir(fx.spark, n) for n in ("events", "lake", "marks"))
    fx["browser_events"].write.parquet(source)
    stream = fx.spark.readStream.schema("experiment string, worker_id string, data_type string, event string").parquet(source)
    _finish(jobs.start_event_sink(stream, root, marks))
    parts = [
        lake.read_raw(fx.spark, root, kind).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("data_type", F.lit(kind))
        for kind in events.KINDS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("experiment_id", "data_type", "n")


@query
def stream_kept_sessions(fx: Fixture) -> DataFrame:
    """The session kept per seed, chosen in the stream over several micro-batches."""
    source, out, marks = (new_run_dir(fx.spark, n) for n in ("requests", "kept", "marks"))
    conform(_raw_requests(fx), REQUESTS).repartition(3, "request_id").write.parquet(source)
    stream = fx.spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
    _finish(sessions.start_session_choice(stream, out, marks, delay="31 days"))
    return sessions.read_kept_sessions(fx.spark, out)


@query
def stream_committed_sink(fx: Fixture) -> DataFrame:
    """Events in committed batches, read back and counted; a batch that broke before its commit is not seen."""
    root, marks = (new_run_dir(fx.spark, n) for n in ("lake", "marks"))
    _finish(commits.start_committed_sink(_deliveries(fx, fx["browser_events"], 2), root, marks))
    # the projection is the work here: every core has a part, whatever partitions the joins of the fixture end in
    broken = fx["browser_events"].where("data_type = 'requests'").repartition(fx.spark.sparkContext.defaultParallelism)
    lake.write_events(events.to_requests(broken), f"{root}/batch=999", "requests")
    parts = [
        lake.read_raw(fx.spark, root, kind, committed=True).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("data_type", F.lit(kind))
        for kind in events.KINDS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("experiment_id", "data_type", "n")


@query
def compacted_lake(fx: Fixture) -> DataFrame:
    """The batches of a stream merged into one; its rows and files, and whether readers see the same rows as before."""
    root, marks = (new_run_dir(fx.spark, n) for n in ("lake", "marks"))
    _finish(commits.start_committed_sink(_deliveries(fx, fx["browser_events"], 4), root, marks))
    keys = ["experiment_id", "data_type"]

    def contents(name: str) -> DataFrame:
        parts = []
        for kind in events.KINDS:
            rows = lake.read_raw(fx.spark, root, kind, committed=True)
            total = F.sum(F.xxhash64(F.to_json(F.struct(*rows.columns))).cast("decimal(38,0)")).alias("total")
            parts.append(rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), total).withColumn("data_type", F.lit(kind)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return _stored(fx, name, out)

    before = contents("before")
    compaction.compact(fx.spark, root)
    after = contents("after").select(*keys, F.col("n").alias("n_after"), F.col("total").alias("total_after"))
    files = compaction.batch_files(fx.spark, root, lake.commit_log(fx.spark, root)).withColumnRenamed("experiment", "experiment_id")
    both = before.join(after, keys, "full").join(files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")), keys, "left")
    same = (F.col("n") == F.col("n_after")) & (F.col("total") == F.col("total_after"))
    return both.select(*keys, "n", "files", F.coalesce(same, F.lit(False)).alias("is_same"))


@query
def stream_requests_dedup(fx: Fixture) -> DataFrame:
    """Redelivered requests dropped in the stream."""
    source, out, marks = (new_run_dir(fx.spark, n) for n in ("delivered", "once", "marks"))
    rows = fx["raw_requests"]
    again = rows.filter("k % 5 = 0")
    conform(rows.unionByName(again).drop("k"), REQUESTS).write.parquet(source)
    stream = fx.spark.readStream.schema(REQUESTS).parquet(source)
    timed = jobs.with_event_time(stream)
    once = jobs.dedup_stream(timed, ["experiment_id", "crawl_session_id", "request_id"], "event_time", "31 days")
    sink = once.drop("event_time").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
    _finish(sink.trigger(availableNow=True).start())
    done = fx.spark.read.schema(REQUESTS).parquet(out)
    return done.select("experiment_id", "request_id", "crawl_session_id", "url", "timestamp")


@query
def stream_progress(fx: Fixture) -> DataFrame:
    """Sessions started per experiment, from the stream."""
    source, out, marks = (new_run_dir(fx.spark, n) for n in ("requests", "progress", "marks"))
    conform(_raw_requests(fx), REQUESTS).write.parquet(source)
    stream = fx.spark.readStream.schema(REQUESTS).parquet(source)
    counts = jobs.stream_progress(stream, "31 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    sink = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", marks)
    _finish(sink.trigger(availableNow=True).start())
    return fx.spark.read.schema(counts.schema).parquet(out)


# -- lake ------------------------------------------------------------------------------------------


@query
def raw_roundtrip(fx: Fixture) -> DataFrame:
    """Raw requests written to the lake and read back."""
    root = new_run_dir(fx.spark, "lake")
    lake.write_events(_raw_requests(fx), root, "requests")
    return lake.read_raw(fx.spark, root, "requests")


@query
def workers_roundtrip(fx: Fixture) -> DataFrame:
    """Worker rows through the system partition, copied to every experiment."""
    root = new_run_dir(fx.spark, "lake")
    lake.write_workers(workers.classify_workers(fx["ip_reports"]), root)
    return lake.read_workers(fx.spark, root, fx["metadata"].select(F.col("exp_id").alias("id")))


@query
def enriched_roundtrip(fx: Fixture) -> DataFrame:
    """The five enriched tables written, read back and counted per experiment."""
    out = new_run_dir(fx.spark, "enriched")
    raw = [fx["raw_responses"], fx["raw_consents"], fx["raw_site_metadata"], fx["raw_worker_metadata"]]
    lake.write_enriched(enriched_tables(_raw_requests(fx), *raw, _rules(fx), _kept(fx), _stored(fx, "single", _requests(fx))), out)
    parts = [
        lake.read_enriched(fx.spark, out, name)
        .groupBy("experiment_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("table_name"), "experiment_id", "n")
        for name in lake.ENRICHED
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def metadata_roundtrip(fx: Fixture) -> DataFrame:
    """S3, K4, K6: experiment documents written as JSON, copied and read back."""
    root, out = new_run_dir(fx.spark, "lake"), new_run_dir(fx.spark, "results")
    found = _raw_requests(fx).groupBy("experiment_id").agg(F.count_distinct("crawled_url").alias("total_urls"))
    params = fx["metadata"].select(F.col("exp_id").alias("experiment_id"), "auto_accept_cookies", "browser_type")
    documents = found.join(params, "experiment_id").select(
        F.col("experiment_id").alias("id"),
        F.lit(datetime(2024, 1, 1, 12, 30)).alias("timestamp"),
        "total_urls",
        F.struct("auto_accept_cookies", "browser_type").alias("params"),
    )
    lake.write_metadata(documents, root)
    lake.copy_metadata(fx.spark, root, out)
    flat = ["auto_accept_cookies", "navigate_subpages", "max_depth", "dwell_time", "browser_type", "headless"]
    return lake.read_metadata(fx.spark, out).select("exp_id", "total_urls", *[f"params.{c}" for c in flat])


@query
def raw_mixed_types(fx: Fixture) -> DataFrame:
    """Consent files with the time as text, number with fraction and whole number, without a column and with one more."""
    root = new_run_dir(fx.spark, "lake")
    rows = fx["raw_consents"]
    firefox, whole = F.col("experiment_id").contains("firefox"), F.col("crawl_depth") % 2 == 1
    number = F.col("timestamp").cast("double")
    lake.write_events(rows.filter(firefox & ~whole).withColumn("timestamp", number), root, "cookie_warning_consents")
    lake.write_events(rows.filter(firefox & whole).withColumn("timestamp", F.floor(number)), root, "cookie_warning_consents")
    other = rows.filter(~firefox).drop("crawl_depth").withColumn("content_type", F.lit("text/html"))
    lake.write_events(other, root, "cookie_warning_consents")
    return lake.read_raw(fx.spark, root, "cookie_warning_consents")


@query
def event_requests_text_form(fx: Fixture) -> DataFrame:
    """Events as collectors type them, with time and headers as text."""
    event = F.to_json(
        F.struct(
            "request_id", "crawl_session_id", "timestamp", "crawled_url", "url", "resource_type", F.lit('{"accept": "*/*"}').alias("headers"), "crawl_depth"
        )
    )
    envelope = _raw_requests(fx).select(F.col("experiment_id").alias("experiment"), "worker_id", F.lit("requests").alias("data_type"), event.alias("event"))
    return events.to_requests(envelope)


@query
def stream_unreadable(fx: Fixture) -> DataFrame:
    """Events of unknown kinds, with broken JSON or without a session, kept by the sink with their text."""
    source, root, marks = (new_run_dir(fx.spark, n) for n in ("events", "lake", "marks"))
    fault = F.col("k") % 10
    good = F.to_json(F.struct("request_id", "crawl_session_id", "url"))
    event = F.when(fault == 1, F.concat(F.lit("{ broken "), F.col("request_id"))).when(fault == 2, F.to_json(F.struct("request_id", "url"))).otherwise(good)
    kind = F.when(fault == 0, F.lit("beacons")).otherwise(F.lit("requests"))
    envelope = fx["raw_requests"].select(F.col("experiment_id").alias("experiment"), "worker_id", kind.alias("data_type"), event.alias("event"))
    envelope.write.parquet(source)
    stream = fx.spark.readStream.schema("experiment string, worker_id string, data_type string, event string").parquet(source)
    _finish(jobs.start_event_sink(stream, root, marks))
    return lake.read_unreadable(fx.spark, root)


@query
def session_starts_null_time(fx: Fixture) -> DataFrame:
    """M1: requests without a time never start a session that has one."""
    rows = fx["raw_requests"].withColumn("timestamp", F.when(F.col("k") % 5 != 0, F.col("timestamp")))
    return models.session_starts(rows).select("experiment_id", "crawl_session_id", "scraped_at")


def _raw_lake(fx: Fixture) -> tuple[str, str]:
    """The raw tables as files of a lake with documents, and filter lists as text files."""
    root = new_run_dir(fx.spark, "lake")
    lake.write_events(_raw_requests(fx), root, "requests")
    lake.write_events(fx["raw_responses"], root, "responses")
    lake.write_events(fx["raw_consents"], root, "cookie_warning_consents")
    lake.write_events(fx["raw_site_metadata"], root, "site_metadata")
    lake.write_workers(fx["raw_worker_metadata"], root)
    _write_documents(fx, root)
    return root, _filter_lists(fx)


def _write_documents(fx: Fixture, root: str) -> None:
    params = F.struct("auto_accept_cookies", "browser_type").alias("params")
    created = F.lit(datetime(2024, 1, 1, 12, 30)).alias("timestamp")
    lake.write_metadata(fx["metadata"].select(F.col("exp_id").alias("id"), created, F.col("total_urls").cast("bigint").alias("total_urls"), params), root)


def _filter_lists(fx: Fixture) -> str:
    """The lists as text files, and one that is not there."""
    folder = new_run_dir(fx.spark, "lists")
    paths = [f"{folder}/{name}.txt" for name in FILTER_LISTS]
    for path, lines in zip(paths, FILTER_LISTS.values(), strict=True):
        fx.spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return ",".join([*paths, f"{folder}/not-there.txt"])


def _contents(fx: Fixture, out: str) -> DataFrame:
    """What the enriched tables and documents hold, as (table_name, experiment_id, key, value)."""
    shown = {
        "labeled_requests": ("request_id", "blocked_by"),
        "responses": ("request_id", "status"),
        "cookie_warning_consents": ("crawl_session_id", "url"),
        "site_metadata": ("crawl_session_id", "description"),
        "worker_metadata": ("worker_id", "country_code"),
    }
    parts = [
        lake.read_enriched(fx.spark, out, name).select(
            F.lit(name).alias("table_name"), "experiment_id", F.col(key).alias("key"), F.col(value).cast("string").alias("value")
        )
        for name, (key, value) in shown.items()
    ]
    documents = lake.read_metadata(fx.spark, out)
    result = documents.select(F.lit("documents").alias("table_name"), F.col("exp_id").alias("experiment_id"), F.col("exp_id").alias("key"), F.col("total_urls").cast("string").alias("value"))
    for part in parts:
        result = result.unionByName(part)
    return result


@query
def enrich_twice(fx: Fixture) -> DataFrame:
    """The whole job over a lake, run twice into one folder; a list that is not there is skipped."""
    (root, filter_lists), out = _raw_lake(fx), new_run_dir(fx.spark, "enriched")
    enrich_lake(fx.spark, root, out, filter_lists)
    enrich_lake(fx.spark, root, out, filter_lists)
    return _contents(fx, out)


@query
def enrich_one_experiment(fx: Fixture) -> DataFrame:
    """Two experiments one after the other, the second without touching the first."""
    (root, filter_lists), out = _raw_lake(fx), new_run_dir(fx.spark, "enriched")
    for experiment in ("firefoxwithcookies_e1", "chromiumnocookies_e0"):
        enrich_lake(fx.spark, root, out, filter_lists, [experiment])
    return _contents(fx, out)


@query
def enrich_increment(fx: Fixture) -> DataFrame:
    """A first delivery, then a second for two experiments; the third one is not read again."""
    root, out, filter_lists = new_run_dir(fx.spark, "lake"), new_run_dir(fx.spark, "enriched"), _filter_lists(fx)
    kinds = {"requests": "raw_requests", "responses": "raw_responses", "cookie_warning_consents": "raw_consents", "site_metadata": "raw_site_metadata"}
    lake.write_workers(fx["raw_worker_metadata"], root)
    _write_documents(fx, root)
    late = (F.col("experiment_id") != "firefoxwithcookies_e1") & (F.pmod(F.xxhash64("crawl_session_id"), F.lit(2)) == 0)
    for delivery in (~late, late):
        for kind, name in kinds.items():
            lake.write_events(fx[name].drop("k").where(delivery), root, kind)
        increment(fx.spark, root, out, filter_lists)
    return _contents(fx, out)


# -- checks of what has no SQL of its own ----------------------------------------------------------


@query
def choose_link_checked(fx: Fixture) -> DataFrame:
    """The size of each page's set of links, and whether the choice is one of them."""
    links = pages.link_sets(_raw_pages(fx))
    chosen = links.select("page_id", F.size(F.array_distinct("links")).cast("bigint").alias("n_links"), "links", pages.choose_link(F.col("links"), F.col("url"), F.lit(0)).alias("link"))
    inside = F.coalesce(F.array_contains("links", F.col("link")), F.col("n_links") == 0)
    return chosen.select("page_id", "n_links", inside.alias("chosen"))


@query
def walk_single_links(fx: Fixture) -> DataFrame:
    """Tasks with depths of their own over pages with one link each, some of which do not load."""
    starts = fx["seeds"].join(_raw_pages(fx).select("page_id", F.col("url").alias("page_url")), "page_id").select(
        F.lit("exp_1").alias("experiment_id"),
        F.col("page_url").alias("url"),
        (F.col("page_id") % 4).cast("int").alias("max_depth"),
        (F.col("page_id") % 7 != 0).alias("navigate_subpages"),
    )
    single = fx["site_links"].groupBy("url").agg(F.min("link").alias("link")).filter("length(url) % 10 <> 3")
    return pages.walk(starts, single.select("url", F.array("link").alias("links")), 3)


@query
def metrics_approx_within(fx: Fixture) -> DataFrame:
    """Exact distinct domains by experiment, and whether the sketch is within five percent."""
    enriched = _stored(fx, "enriched", _enriched_weighted(fx).select("experiment_id", "request_requested_domain", "copies"))
    exact = enriched.groupBy("experiment_id").agg(
        F.count_distinct("request_requested_domain").alias("exact"), F.approx_count_distinct("request_requested_domain", 0.02).alias("about")
    )
    return exact.select("experiment_id", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("is_close"))


@query
def metrics_from_cube(fx: Fixture) -> DataFrame:
    """Measures by resource type and browser, also of one page type, from a stored cube; its sketches within five percent."""
    enriched = _stored(fx, "enriched", _enriched_weighted(fx))
    dims = ["experiment_id", "request_resource_type", "request_page_type", "experiment_browser_type", "website_legal_zone"]
    asked = ["request_resource_type", "experiment_browser_type"]
    cube = build_cube(enriched, new_run_dir(fx.spark, "cube"), dims, [[*asked, "request_page_type"], ["experiment_id"]])
    measures = [*_EXACT, "unique_domains_contacted"]
    page = enriched.agg(F.max("request_page_type")).first()[0]
    exact = enriched.groupBy(*asked).agg(F.count_distinct("request_requested_domain").alias("exact"))
    everything = cube.query(asked, measures).withColumn("pages", F.lit("all"))
    both = everything.unionByName(cube.query(asked, measures, {"request_page_type": page}).withColumn("pages", F.lit("one")))
    found = both.join(exact, [both[c].eqNullSafe(exact[c]) for c in asked], "left")
    near = F.abs(F.col("unique_domains_contacted") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.select("pages", *[both[c] for c in asked], *_EXACT, F.when(F.col("pages") == "all", near).alias("is_close"))


@query
def tranco_csv(fx: Fixture) -> DataFrame:
    """The ranked list through headerless CSV files."""
    path = new_run_dir(fx.spark, "tranco")
    fx["tranco"].select("tranco_rank", "domain").write.csv(path)
    return lists.read_tranco(fx.spark, path)


@query
def countries_csv(fx: Fixture) -> DataFrame:
    """The catalogue through CSV files with a header and more columns."""
    path = new_run_dir(fx.spark, "countries")
    fx["countries"].select(F.lit("a, \"quoted\" name").alias("name"), "tld", "cca2", "region", "subregion").write.option("header", True).option("escape", '"').csv(path)
    return lists.read_countries(fx.spark, path)


@query
def listed_documents(fx: Fixture) -> DataFrame:
    """Experiments found by listing documents, one for each customer's orders, and whether each can be read."""
    root = new_run_dir(fx.spark, "lake")
    ids = fx.source("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total_urls"))
    ids = ids.select(F.concat(F.lit("exp"), F.col("o_custkey").cast("string")).alias("id"), "total_urls", (F.col("o_custkey") % 5).alias("fault"))
    params = F.struct(F.lit(True).alias("auto_accept_cookies"), F.lit("firefox").alias("browser_type")).alias("params")
    whole = ids.where("fault > 1").select("id", F.lit(datetime(2024, 1, 1, 12, 30)).alias("timestamp"), "total_urls", params)
    lake.write_metadata(whole, root)
    # broken JSON, and a document without what an experiment needs
    text = F.when(F.col("fault") == 0, F.concat(F.lit('{"id": "'), "id")).otherwise(F.to_json(F.struct("id", "total_urls")))
    lake.write_documents(ids.where("fault <= 1").select(F.col("id").alias("experiment"), text.alias("value")), root)
    listed = lake.list_experiments(lake.metadata_keys(fx.spark, root))
    read = lake.read_metadata(fx.spark, root).select(F.col("exp_id").alias("id"), "total_urls")
    return listed.join(read, "id", "left").select("id", "total_urls", F.col("total_urls").isNotNull().alias("is_readable"))


@query
def flush_files(fx: Fixture) -> DataFrame:
    """K3: files of a flush hold at most a hundred records, as the footers' row counts tell."""
    root = new_run_dir(fx.spark, "lake")
    rows = _stored(fx, "flushed", _raw_requests(fx))
    order = F.coalesce(times.epoch_micros(F.col("timestamp")), F.lit(0))
    lake.write_flushes(rows, root, "requests", order, ["request_id"], records_per_file=100)
    rows = fx.spark.read.parquet(root).select("experiment", F.input_file_name().alias("file"))
    sizes = rows.groupBy("experiment", "file").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("experiment").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("files"), F.max("n").alias("largest"))


@query
def model_inputs(fx: Fixture) -> DataFrame:
    """What the models read of the enriched tables: responses, site metadata, consent sessions."""
    out = new_run_dir(fx.spark, "enriched")
    lake.write_table(_responses(fx), f"{out}/responses", ["experiment_id"])
    lake.write_table(_sites(fx), f"{out}/site_metadata", ["experiment_id"])
    lake.write_table(_consents(fx), f"{out}/cookie_warning_consents", ["experiment_id"])
    read = lambda name: lake.read_enriched(fx.spark, out, name)
    answers = lake.read_responses(read("responses"))
    sites = lake.read_site_metadata(read("site_metadata"))
    consents = lake.read_consent_sessions(read("cookie_warning_consents"))
    micros = F.unix_micros(F.col("scraped_at").cast("timestamp"))
    parts = [
        answers.select(F.lit("responses").alias("input"), "experiment_id", "crawl_session_id", F.col("request_id").alias("key"), F.col("status").cast("bigint").alias("value")),
        sites.select(F.lit("site_metadata").alias("input"), "experiment_id", "crawl_session_id", F.lit("").alias("key"), micros.alias("value")),
        consents.select(F.lit("consents").alias("input"), "experiment_id", "crawl_session_id", F.lit("").alias("key"), F.lit(1).cast("bigint").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def experiment_status_listed(fx: Fixture) -> DataFrame:
    """Listed experiments, one with an unreadable document, with known and with unknown queues."""
    listed = _documents(fx).select("id").unionByName(fx.spark.range(1).select(F.lit("broken_e9").alias("id")))
    documents = status.listed_documents(listed, _documents(fx))
    known = status.status_table(status.experiment_status(documents, fx["queue_depths"])).withColumn("queue", F.lit("known"))
    unknown = status.status_table(status.experiment_status(documents, None)).withColumn("queue", F.lit("unknown"))
    return known.unionByName(unknown)
