"""Metrics views: named dimensions and measures over a model."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DASHBOARD_TIME_ZONES

GRAINS = ["microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year"]


@dataclass(frozen=True)
class MetricsView:
    """A model with dimensions (name to column) and measures (name to aggregate).

    ``label`` texts are for display only. ``time`` names a zone-less UTC timestamp;
    ``smallest_grain`` is the finest grain a time series may have.
    """

    model: DataFrame
    dimensions: dict[str, Column]
    measures: dict[str, Column]
    time: str | None = None
    smallest_grain: str = "microsecond"
    labels: dict[str, str] = field(default_factory=dict)

    def _measures(self, names: list[str]) -> list[Column]:
        unknown = [n for n in names if n not in self.measures]
        if unknown:
            raise KeyError(f"unknown measures: {unknown}")
        return [self.measures[n].alias(n) for n in names]

    def _dimensions(self, names: list[str]) -> list[Column]:
        unknown = [n for n in names if n not in self.dimensions]
        if unknown:
            raise KeyError(f"unknown dimensions: {unknown}")
        return [self.dimensions[n].alias(n) for n in names]

    def where(self, condition: Column | str) -> MetricsView:
        """The view limited to rows that meet the condition."""
        return replace(self, model=self.model.filter(condition))

    def last(self, hours: int, periods_back: int = 0) -> MetricsView:
        """The last ``hours`` before the newest row, or the window of that length ``periods_back`` earlier."""
        end = self.model.agg(F.max(self.time)).scalar()
        span = F.make_dt_interval(F.lit(0), F.lit(hours * periods_back))
        width = F.make_dt_interval(F.lit(0), F.lit(hours * (periods_back + 1)))
        t = F.col(self.time)
        return self.where((t > end - width) & (t <= end - span))

    def query(
        self, dims: list[str], measures: list[str], sort: str | None = None, limit: int | None = None
    ) -> DataFrame:
        """Measures grouped by dimensions; sorted descending by ``sort`` (ties by dimension) and limited on request."""
        grouped = self.model.groupBy(*self._dimensions(dims)).agg(*self._measures(measures))
        if sort:
            grouped = grouped.orderBy(F.desc(sort), *dims)
        return grouped.limit(limit) if limit else grouped

    def timeseries(self, grain: str, dims: list[str], measures: list[str], tz: str = "UTC") -> DataFrame:
        """Measures per time grain in a time zone, as ``time`` and the dimensions."""
        if GRAINS.index(grain) < GRAINS.index(self.smallest_grain):
            raise ValueError(f"grain must not be finer than {self.smallest_grain}")
        if tz not in DASHBOARD_TIME_ZONES:
            raise ValueError(f"time zone must be one of {DASHBOARD_TIME_ZONES}")
        local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(self.time))
        step = F.date_trunc(grain, local).cast("timestamp_ntz").alias("time")
        return self.model.groupBy(step, *self._dimensions(dims)).agg(*self._measures(measures))

    def compare(self, hours: int, dims: list[str], measures: list[str]) -> DataFrame:
        """Measures of the last period, ``_previous`` those of the one before, and ``_delta`` between them.

        One scan: rows of both periods are grouped by dimension and period, then
        the two periods of a dimension are put side by side.
        """
        end = self.model.agg(F.max(self.time)).scalar()
        one = F.make_dt_interval(F.lit(0), F.lit(hours))
        two = F.make_dt_interval(F.lit(0), F.lit(2 * hours))
        t = F.col(self.time)
        recent = self.model.filter((t > end - two) & (t <= end)).withColumn("__now", t > end - one)
        parts = recent.groupBy(*self._dimensions(dims), "__now").agg(*self._measures(measures))
        now, before = F.col("__now"), ~F.col("__now")
        sides = [F.max(F.when(now, F.col(m))).alias(m) for m in measures]
        sides += [F.max(F.when(before, F.col(m))).alias(f"{m}_previous") for m in measures]
        both = parts.groupBy(*dims).agg(*sides)
        deltas = [(F.col(m) - F.col(f"{m}_previous")).alias(f"{m}_delta") for m in measures]
        return both.select("*", *deltas)


# Dimensions of the site summary view and their titles.
SITE_DIMENSIONS = {
    "request_crawled_url": "Seed Website",
    "request_page_type": "Page Type (Homepage vs Subpage)",
    "request_crawl_depth_int": "Exact Crawl Depth",
    "request_requested_domain": "Tracker / Target Domain",
    "request_blocked_by": "Blocked By (Filter Lists)",
    "request_is_tracker": "Is Known Tracker/Ad",
    "cookie_request_class": "Cookie Behavior Class",
    "min_depth": "Minimum Crawl Depth Required",
    "experiment_browser_type": "Browser Type",
    "browser_signature": "Tracker Browser Signature",
    "response_status": "HTTP Status Code",
    "request_resource_type": "Resource Type",
    "experiment_id": "Experiment ID",
    "experiment_auto_accept_cookies": "Auto-Accepted Cookies?",
    "experiment_navigate_subpages": "Navigated Subpages?",
    "worker_country_code": "Worker Country",
    "worker_is_residential": "Is Residential IP",
    "seed_rank_bucket": "Website Rank (Tranco)",
    "website_legal_zone": "Website Legal Zone (GDPR)",
    "website_continent": "Website Continent",
}
# Titles of the measures.
MEASURE_TITLES = {
    "total_network_requests": "Total Network Requests",
    "total_trackers_loaded": "Total Trackers Loaded",
    "unique_domains_contacted": "Unique Domains Contacted",
    "total_seed_domains": "Total Seed Domains",
    "sites_completed": "Sites Completed",
}


def site_summary_view(enriched: DataFrame) -> MetricsView:
    """View over the enriched site summary.

    A ``copies`` column (rows counted instead of repeated) weighs the counts, so
    the view needs no repeated rows.
    """
    weight = F.col("copies") if "copies" in enriched.columns else F.lit(1).cast("bigint")
    return MetricsView(
        model=enriched,
        dimensions={name: F.col(name) for name in SITE_DIMENSIONS},
        measures={
            "total_network_requests": F.coalesce(F.sum(weight), F.lit(0)).cast("bigint"),
            "total_trackers_loaded": F.sum(F.when(F.col("request_is_tracker"), weight).otherwise(F.lit(0))).cast("bigint"),
            "unique_domains_contacted": F.approx_count_distinct("request_requested_domain", 0.02),
            "total_seed_domains": F.count_distinct("seed_domain"),
        },
        labels={**SITE_DIMENSIONS, **MEASURE_TITLES},
    )


def crawl_progress_view(progress: DataFrame) -> MetricsView:
    """View over the crawl progress, with time grains from a minute up."""
    return MetricsView(
        model=progress,
        dimensions={"experiment_id": F.col("experiment_id")},
        measures={"sites_completed": F.max("sites_completed")},
        time="scraped_at",
        smallest_grain="minute",
        labels={"experiment_id": "Experiment", **MEASURE_TITLES},
    )
