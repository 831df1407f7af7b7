"""Report tables: bot detection, consent share, outcomes, progress, overview, agreement, workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BLOCKED_MAX_OK,
    OUTCOME_BLOCKED,
    OUTCOME_CLIENT_ERROR,
    OUTCOME_LOADED,
    OUTCOME_NO_RESPONSE,
    OUTCOME_OTHER,
    OUTCOME_REDIRECT,
    OUTCOME_SERVER_ERROR,
    TARGET_SEEDS,
    WITH_WARNING,
    WITHOUT_WARNING,
)
from ..functions import times
from ..operators.joins import latest_rows

SESSION = ["experiment_id", "crawl_session_id"]


def main_documents(responses: DataFrame) -> DataFrame:
    """Responses seen while the seed page loaded."""
    return responses.filter("crawl_depth = 0").select("experiment_id", "crawled_url", "url", "status")


# -- bot detection ---------------------------------------------------------------------------------


def blocked_sites(main: DataFrame) -> DataFrame:
    """(experiment, seed) whose own URL got 403 and that had at most five responses with 200.

    One aggregation gives both facts per seed; the number of 403 responses is kept in ``hits``.
    """
    per_seed = main.groupBy("experiment_id", "crawled_url").agg(
        F.count_if((F.col("url") == F.col("crawled_url")) & (F.col("status") == 403)).alias("hits"),
        F.count_if(F.col("status") == 200).alias("ok"),
    )
    return per_seed.filter((F.col("hits") > 0) & (F.col("ok") <= BLOCKED_MAX_OK)).select("experiment_id", "crawled_url", "hits")


def _browser() -> Column:
    return F.when(F.ilike(F.col("experiment_id"), F.lit("%firefox%")), F.lit("Firefox")).otherwise(F.lit("Chromium")).alias("browser")


def _percent(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole)) * 100


def bot_detection_by_browser(main: DataFrame) -> DataFrame:
    """Seeds asked for and seeds blocked per browser, with the share; browsers without blocks drop out."""
    asked = main.filter("url = crawled_url").groupBy(_browser()).agg(F.count_distinct("crawled_url").alias("total"))
    blocks = blocked_sites(main).groupBy(_browser()).agg(F.count_distinct("crawled_url").alias("blocked"))
    both = asked.join(blocks, on="browser")
    return both.withColumn("blocked_pct", _percent("blocked", "total")).orderBy("browser")


def bot_detection_overall(main: DataFrame) -> DataFrame:
    """Seeds asked for and seeds blocked over all experiments, with the share."""
    total = main.filter("url = crawled_url").agg(F.count_distinct("crawled_url")).scalar()
    blocks = blocked_sites(main).agg(F.count_distinct("crawled_url").alias("blocked"))
    return blocks.select(total.alias("total"), "blocked").withColumn("blocked_pct", _percent("blocked", "total"))


# -- consent ---------------------------------------------------------------------------------------


def successful_sessions(site_metadata: DataFrame) -> DataFrame:
    """Sessions that left site metadata."""
    return site_metadata.select(*SESSION).distinct()


def _in_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct rows whose session is among the given ones.

    Reduced before the join: what is left of a session is one row per depth and seed.
    """
    return rows.distinct().join(sessions, SESSION, "left_semi")


def cookie_warnings(requests: DataFrame, consents: DataFrame, site_metadata: DataFrame) -> DataFrame:
    """Seeds with and without a consent click, over successful sessions."""
    good = successful_sessions(site_metadata)
    roots = _in_sessions(requests.filter("crawl_depth = 0").select(*SESSION, "crawled_url"), good)
    clicked = _in_sessions(consents.select(*SESSION, "crawled_url"), good)
    total = roots.agg(F.count_distinct("crawled_url")).scalar()
    return clicked.agg(F.count_distinct("crawled_url").alias("with_cookie")).select(
        "with_cookie", (total - F.col("with_cookie")).alias("without_cookie")
    )


def cookie_warnings_share(counts: DataFrame) -> DataFrame:
    """The two counts as rows with percentage and label."""
    total = F.col("with_cookie") + F.col("without_cookie")
    entries = F.array(
        F.struct(F.lit(WITH_WARNING).alias("category"), F.col("with_cookie").alias("count")),
        F.struct(F.lit(WITHOUT_WARNING).alias("category"), F.col("without_cookie").alias("count")),
    )
    long = counts.select(total.alias("total"), F.explode(entries).alias("e")).select("e.category", "e.count", "total")
    pct = _percent("count", "total")
    return long.select(
        "category", "count", pct.alias("pct"), F.concat(F.lit("~"), _one_decimal(pct), F.lit("%")).alias("label")
    )


def _one_decimal(number: Column) -> Column:
    """Rounded to one decimal, without a trailing ``.0``."""
    return F.regexp_replace(F.round(number, 1).cast("decimal(18,1)").cast("string"), r"\.0$", "")


# -- outcomes --------------------------------------------------------------------------------------


def outcome_flags(main: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How the seed URL itself was answered, and the number of pages with 200, per seed (and the columns of ``by``)."""
    own = F.col("url") == F.col("crawled_url")
    status = F.col("status")

    def seen(condition: Column) -> Column:
        return F.coalesce(F.bool_or(own & condition), F.lit(False))

    return main.groupBy(*(by or []), "crawled_url").agg(
        seen(status.between(200, 299)).alias("answered"),
        seen(status.between(300, 399)).alias("moved"),
        seen(status == 403).alias("refused"),
        seen(status.between(400, 499) & (status != 403)).alias("client_error"),
        seen(status.between(500, 599)).alias("server_error"),
        F.count_if(status == 200).alias("ok_pages"),
    )


# class and condition, in order of precedence: the first condition that holds decides
OUTCOMES = (
    (OUTCOME_LOADED, "answered"),
    (OUTCOME_LOADED, "moved AND ok_pages > 0"),
    (OUTCOME_REDIRECT, "moved"),
    (OUTCOME_LOADED, f"refused AND ok_pages > {BLOCKED_MAX_OK}"),
    (OUTCOME_BLOCKED, "refused"),
    (OUTCOME_CLIENT_ERROR, "client_error"),
    (OUTCOME_SERVER_ERROR, "server_error"),
    (OUTCOME_OTHER, "true"),
)


def outcome_class(flags: DataFrame) -> DataFrame:
    """Adds ``category`` by the table above."""
    return flags.withColumn("category", F.coalesce(*[F.when(F.expr(when), F.lit(name)) for name, when in OUTCOMES]))


def crawl_outcomes(main: DataFrame) -> DataFrame:
    """Seeds per outcome class, over all experiments."""
    return outcome_class(outcome_flags(main)).groupBy("category").agg(F.count(F.lit(1)).alias("sites"))


def crawl_outcomes_by_experiment(main: DataFrame) -> DataFrame:
    """Seeds per experiment and outcome class, most frequent first."""
    classed = outcome_class(outcome_flags(main, ["experiment_id"]))
    counts = classed.groupBy("experiment_id", "category").agg(F.count(F.lit(1)).alias("sites"))
    return counts.orderBy("experiment_id", F.desc("sites"), "category")


def with_no_response(outcomes: DataFrame, total: int = TARGET_SEEDS, by: list[str] | None = None) -> DataFrame:
    """Adds a row for seeds that never answered, and percentages of the seed total."""
    by = by or []
    silent = outcomes.groupBy(*by).agg((F.lit(total).cast("bigint") - F.coalesce(F.sum("sites"), F.lit(0))).alias("sites"))
    rows = outcomes.unionByName(silent.withColumn("category", F.lit(OUTCOME_NO_RESPONSE)))
    return rows.withColumn("pct", F.col("sites") / F.lit(float(total)) * 100)


def outcome_chart_table(rows: DataFrame) -> DataFrame:
    """Classes that occur, largest first, with legend text; chart text from five percent up."""
    sites = F.format_number("sites", 0)
    text = F.concat(F.col("category"), F.lit("\n"), sites, F.lit(" sites ("), _one_decimal(F.col("pct")), F.lit("%)"))
    return (
        rows.filter("sites > 0")
        .select(
            "category",
            "sites",
            "pct",
            F.when(F.col("pct") >= 5, text).otherwise(F.lit("")).alias("chart_label"),
            text.alias("legend_label"),
        )
        .orderBy(F.desc("pct"), "category")
    )


# -- progress --------------------------------------------------------------------------------------


def experiment_title(column: Column, titles: dict[str, str]) -> Column:
    """Display title of an experiment id; ids without a title become NULL."""
    out = F.when(F.lit(False), F.lit(""))
    for name, title in titles.items():
        out = out.when(column == name, F.lit(title))
    return out


def progress_hours(progress: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Progress with experiment titles and hours since the first event of all."""
    start = progress.agg(F.min("scraped_at")).scalar()
    return progress.select(
        experiment_title(F.col("experiment_id"), titles).alias("experiment"),
        "scraped_at",
        "sites_completed",
        times.hours_between(F.col("scraped_at"), start).alias("hours_elapsed"),
    )


def progress_trend(hours: DataFrame, experiment: str, cutoff_hours: float, ahead: float = 3.0) -> DataFrame:
    """Straight line through one experiment up to a cut-off, read at the cut-off and three hours past the end."""
    one = hours.filter(F.col("experiment") == experiment)
    early = F.col("hours_elapsed") <= cutoff_hours
    x, y = F.when(early, F.col("hours_elapsed")), F.when(early, F.col("sites_completed").cast("double"))
    fit = one.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max("hours_elapsed").alias("last")
    )
    points = fit.withColumn("hours_elapsed", F.explode(F.array(F.lit(float(cutoff_hours)), F.col("last") + ahead)))
    return points.select("hours_elapsed", (F.col("intercept") + F.col("slope") * F.col("hours_elapsed")).alias("sites_completed"))


# -- overview --------------------------------------------------------------------------------------


def experiment_overview(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests, responses and trackers per experiment that has both."""
    left = requests.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("blocked_by").isNotNull() & (F.col("blocked_by") != "[]")).alias("trackers"),
    )
    right = responses.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("responses"))
    return left.join(right, "experiment_id").select("experiment_id", "requests", "responses", "trackers")


def experiment_overview_long(overview: DataFrame) -> DataFrame:
    """The overview with one row per experiment and metric."""
    long = overview.unpivot("experiment_id", ["requests", "responses", "trackers"], "metric", "count")
    return long.withColumn("metric", F.initcap("metric"))


# -- agreement -------------------------------------------------------------------------------------


def session_roots(requests: DataFrame, site_metadata: DataFrame) -> DataFrame:
    """(experiment, session, root URL) of successful sessions, from documents of depth 0."""
    docs = requests.filter("crawl_depth = 0 AND resource_type = 'document'").select(*SESSION, F.col("crawled_url").alias("root_url"))
    return _in_sessions(docs, successful_sessions(site_metadata))


def shared_roots(roots: DataFrame, requests: DataFrame) -> DataFrame:
    """Root URLs seen by every experiment that has requests."""
    every = requests.agg(F.count_distinct("experiment_id")).scalar()
    counts = roots.groupBy("root_url").agg(F.count_distinct("experiment_id").alias("n"))
    return counts.filter(F.col("n") == every).select("root_url")


def hop_agreement(requests: DataFrame, site_metadata: DataFrame) -> DataFrame:
    """Per depth: hops, hops all experiments made, and their share, over roots all experiments reached."""
    every = requests.agg(F.count_distinct("experiment_id")).scalar()
    roots = session_roots(requests, site_metadata)
    sessions = roots.join(shared_roots(roots, requests), "root_url", "left_semi").select(*SESSION).distinct()
    docs = requests.filter("resource_type = 'document'").select(*SESSION, "crawl_depth", "crawled_url")
    hops = _in_sessions(docs, sessions).select("experiment_id", "crawl_depth", "crawled_url").distinct()
    per_hop = hops.groupBy("crawl_depth", "crawled_url").agg(F.count(F.lit(1)).alias("n"))
    per_level = per_hop.groupBy("crawl_depth").agg(
        F.count(F.lit(1)).alias("total_hops"), F.sum(F.when(F.col("n") == every, 1).otherwise(0)).alias("shared_hops")
    )
    share = F.round(F.lit(100.0) * F.col("shared_hops").cast("double") / F.col("total_hops"), 1)
    return per_level.withColumn("pct_shared", share).orderBy("crawl_depth")


# -- workers ---------------------------------------------------------------------------------------


def worker_distribution(requests: DataFrame, workers: DataFrame, top: int | None = None) -> DataFrame:
    """Sessions per country of the worker that ran them, most first; unknown workers count as Unknown."""
    sites = requests.groupBy("worker_id").agg(F.count_distinct("crawl_session_id").alias("sites"))
    places = latest_rows(workers.select("worker_id", "timestamp", "country_code"), ["worker_id"], ["timestamp"])
    placed = sites.join(places.select("worker_id", "country_code"), "worker_id", "left")
    out = (
        placed.groupBy(F.coalesce("country_code", F.lit("Unknown")).alias("country_code"))
        .agg(F.sum("sites").alias("sites_crawled"))
        .orderBy(F.desc("sites_crawled"), "country_code")
    )
    return out.limit(top) if top else out
