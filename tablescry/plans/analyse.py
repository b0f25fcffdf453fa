"""The whole automatic analysis of a table, and the three bundles by shape."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescry.operators import chartdata, geo, timeseries
from tablescry.operators.aggregates import kpis, number_of, numeric_columns, rank_groups, summary_stats
from tablescry.operators.correlation import correlation_matrix
from tablescry.operators.findings import all_findings, briefing, finding_counts, ranked_findings
from tablescry.operators.profile import TableProfile, profile_table
from tablescry.operators.quality import health_issues, health_score
from tablescry.operators.routing import Routing, route_profile
from tablescry.operators.value_counts import category_counts
from tablescry.session import cut_lineage


MAX_BARS = 15


class Analysis:
    """The parts of an automatic analysis, each worked out when first asked for.

    One profile with its audit feeds all of them, and the quantiles and
    duplicate counts of the audit are not computed again for the findings.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.spark = df.sparkSession
        self.known = profile_table(df, "sketch", audit=True)
        self.roles = route_profile(self.known)

    @property
    def profile(self) -> DataFrame:
        return self.known.table(self.spark)

    @property
    def routing(self) -> DataFrame:
        return self.roles.table(self.spark)

    @cached_property
    def issues(self) -> DataFrame:
        return health_issues(self.df, self.known)

    @cached_property
    def report(self) -> DataFrame:
        return health_score(self.issues, self.known.n_rows)

    @cached_property
    def found(self) -> DataFrame:
        """Everything found: a few dozen rows, kept before they are ranked and counted."""
        copies = self.issues.where("kind = 'duplicate_rows'").select("n_affected").first()
        return cut_lineage(all_findings(self.df, self.known, self.roles, copies["n_affected"] if copies else 0))

    @property
    def findings(self) -> DataFrame:
        return ranked_findings(self.found)

    @property
    def counts(self) -> DataFrame:
        return finding_counts(self.found)

    @cached_property
    def kpis(self) -> DataFrame:
        return kpis(self.df, self.known)

    @cached_property
    def charts(self) -> DataFrame:
        return chartdata.chart_candidates(self.df, self.known, self.roles)

    @property
    def briefing(self) -> DataFrame:
        return briefing(self.findings, self.issues, self.report, self.known)


def analyse(df: DataFrame) -> Analysis:
    """Profile, route, audit, find, and propose charts."""
    return Analysis(df)


def analysis_report(df: DataFrame) -> DataFrame:
    """Issues and findings of a table in one list: section, subject, measure of size, score."""
    result = analyse(df)
    issues = result.issues.select(
        F.lit("issue").alias("section"), "kind", F.concat_ws("+", "columns").alias("subject"),
        F.col("pct_affected").alias("value"), F.col("penalty").alias("score"),
    )
    findings = result.findings.select(F.lit("finding").alias("section"), "kind", "subject", "value", "score")
    return issues.unionByName(findings)


@dataclass
class Bundle:
    """Tables that belong on one page, or the reason there are none."""

    status: str
    message: str = ""
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _missing(column: str | None, df: DataFrame) -> bool:
    return not column or column not in df.columns


def timeseries_bundle(df: DataFrame, roles: Routing, freq: str = "D", window: int = 7) -> Bundle:
    """Resampled series with its rolling mean, the split by entity, statistics and slope."""
    if _missing(roles.time_col, df):
        return Bundle("insufficient_data", "no usable date column")
    if _missing(roles.target_col, df):
        return Bundle("insufficient_data", "no usable numeric column")
    series = cut_lineage(timeseries.resample(df, roles.time_col, roles.target_col, freq))
    if series.where("value is not null").limit(2).count() < 2:
        return Bundle("insufficient_data", "fewer than two periods hold a value")
    tables = {
        "series": timeseries.rolling_mean(series, window),
        "stats": timeseries.series_stats(series),
        "trend": timeseries.trend_slope(series),
    }
    if not _missing(roles.entity_col, df):
        tables["by_entity"] = timeseries.resample_by_entity(df, roles.time_col, roles.target_col, roles.entity_col, freq)
    return Bundle("ok", tables=tables)


def geo_bundle(df: DataFrame, roles: Routing, time_window: tuple | None = None) -> Bundle:
    """Points with marker sizes, the view, the busiest cell and statistics."""
    if _missing(roles.lat_col, df) or _missing(roles.lon_col, df):
        return Bundle("insufficient_data", "no coordinate columns")
    if _missing(roles.target_col, df):
        return Bundle("insufficient_data", "no numeric column to size the points by")
    shown = geo.in_window(df, roles.time_col, time_window)
    at = (roles.lat_col, roles.lon_col, roles.target_col)
    if geo.placeable(shown, *at).isEmpty():
        return Bundle("insufficient_data", "no row has a usable coordinate and measure")
    return Bundle("ok", tables={
        "points": geo.map_points(shown, *at), "view": geo.map_view(shown, *at),
        "densest_cell": geo.densest_cell(shown, *at), "stats": geo.geo_stats(shown, *at),
    })


def tabular_bundle(df: DataFrame, roles: Routing) -> Bundle:
    """Distribution, comparison by entity, counts, summary and correlations."""
    target = roles.target_col
    if _missing(target, df):
        return Bundle("insufficient_data", "no target column to describe")
    if df.where(number_of(df, target).isNotNull()).isEmpty():
        return Bundle("insufficient_data", f"{target!r} holds no numbers")
    tables = {"distribution": chartdata.histogram(df, target), "summary": summary_stats(df, target)}
    if not _missing(roles.entity_col, df):
        tables["by_entity"] = rank_groups(df, roles.entity_col, target, "mean", MAX_BARS)
        tables["category_counts"] = category_counts(df, roles.entity_col)
    numbers = numeric_columns(df)
    if len(numbers) >= 2:
        tables["correlation"] = correlation_matrix(df, numbers)
    return Bundle("ok", tables=tables)


def world(df: DataFrame, known: TableProfile | None = None, **options) -> Bundle:
    """The bundle that fits the table's shape."""
    roles = route_profile(known or profile_table(df, "sketch"))
    if roles.archetype == "geo":
        return geo_bundle(df, roles, options.get("time_window"))
    if roles.archetype == "timeseries":
        return timeseries_bundle(df, roles, options.get("freq", "D"), options.get("window", 7))
    return tabular_bundle(df, roles)
