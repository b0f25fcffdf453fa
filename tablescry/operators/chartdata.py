"""The tables behind charts: bins, boxes, bars, points, and which to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescry.functions.names import NotCalculable, default_aggregate
from tablescry.operators.aggregates import drop_unusable, keep_top_values, number_of, rank_groups, row_sample, stamp_of
from tablescry.operators.correlation import best_pair, correlation_matrix, linear_fit
from tablescry.operators.profile import TableProfile, profile_table
from tablescry.operators.quantiles import exact_quantiles
from tablescry.operators.routing import Routing, best_category, chart_categories, chart_measures, route_profile, variation
from tablescry.operators.timeseries import resample

BINS = 30
DEFAULT_BARS, BOX_GROUPS, SCATTER_POINTS, MAX_CHARTS = 12, 8, 4000, 6
SCATTER_MIN_R, GRID_MIN_COLUMNS = 0.35, 3


def line_data(df: DataFrame, time: str, measure: str, agg: str = "mean", freq: str | None = None) -> DataFrame:
    return resample(df, time, measure, freq, agg)


def bar_data(df: DataFrame, group: str, measure: str, agg: str = "mean", limit: int = DEFAULT_BARS, ascending: bool = False) -> DataFrame:
    return rank_groups(df, group, measure, agg, limit, "bottom" if ascending else "top").select("group", "value", "rows")


def histogram(df: DataFrame, measure: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins from lowest to highest value; the top value is in the last bin."""
    values = df.select(number_of(df, measure).alias("v")).where("v is not null")
    ends = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))).scalar()
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        values.select("v", ends.alias("ends"))
        .select("v", "ends.*")
        .select(place.cast("int").alias("bin"), "lo", width.alias("width"), "mean")
        .groupBy("bin", "lo", "width", "mean")
        .agg(F.count("*").alias("n"))
        .select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
                (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "n", "mean")
    )


def box_stats(df: DataFrame, group: str, measure: str, k: int = BOX_GROUPS) -> DataFrame:
    """Quartiles, whiskers at 1.5 quartile ranges and outlier counts of the k largest groups."""
    usable, _ = drop_unusable(df, {"group": F.col(f"`{group}`").cast("string"), "v": number_of(df, measure)})
    kept = keep_top_values(usable, "group", max(1, int(k)))
    quartiles = exact_quantiles(kept, ["group"], [0.25, 0.5, 0.75]).groupBy("group").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q75"),
    )
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("v") >= F.col("q25") - reach) & (F.col("v") <= F.col("q75") + reach)
    return (
        kept.join(F.broadcast(quartiles), "group")  # k groups
        .groupBy("group", "q25", "median", "q75")
        .agg(
            F.count("*").alias("rows"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def scatter_data(df: DataFrame, x: str, y: str, key: list[str] | None = None, max_points: int | None = None) -> DataFrame:
    """Pairs with both values; with ``max_points`` a repeatable sample chosen by key."""
    columns = {**{k: F.col(f"`{k}`") for k in (key or [])}, "x": number_of(df, x), "y": number_of(df, y)}
    pairs, _ = drop_unusable(df, columns)
    if max_points is None:
        return pairs
    if not key:
        raise NotCalculable("a sample of points needs key columns to be repeatable")
    return row_sample(pairs, max_points, key)


def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """The best-fit line's two ends, from every row."""
    fit = linear_fit(df, x, y).where("slope is not null")
    return fit.select(
        F.explode(F.array("x_min", "x_max")).alias("x"), "slope", "intercept", "n"
    ).select("x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"), "n")


def heatmap_data(df: DataFrame, columns: list[str]) -> DataFrame:
    return correlation_matrix(df, columns).select("a", "b", F.round("r", 2).alias("r"))


CANDIDATE_SCHEMA = "kind string, chart string, x string, y string, agg string, score double"


def chart_candidates(
    df: DataFrame, known: TableProfile | None = None, roles: Routing | None = None, limit: int = MAX_CHARTS
) -> DataFrame:
    """Scored chart proposals, one per kind, best first. Nothing is drawn or built."""
    known = known or profile_table(df, "sketch")
    roles = roles or route_profile(known)
    measures, categories = chart_measures(known, roles.target_col), chart_categories(known)
    primary = measures[0] if measures else None
    time = roles.time_col
    rows: list[tuple] = []
    if time and primary:
        stamp = F.to_date(stamp_of(df, time))
        days = df.agg(F.count_distinct(stamp).alias("days")).first()["days"]
        if days >= 3:
            rows.append(("trend", "line", time, primary, default_aggregate(primary), 10.0 + min(days / 100.0, 1.0)))
    category = best_category(df, categories, primary) if primary and categories else None
    if category:
        rows.append(("ranking", "bar", category, primary, default_aggregate(primary), 9.0))
    latitude, longitude = known.of_type("geo_lat"), known.of_type("geo_lon")
    if latitude and longitude and primary:
        rows.append(("map", "map", f"{latitude[0]},{longitude[0]}", primary, None, 8.5))
    if len(measures) >= 2:
        usable = [m for m in measures if known.facts.columns[m]["n_numbers"] >= 10]
        pair = best_pair(df, usable).first() if len(usable) >= 2 else None
        if pair and abs(pair["r"]) >= SCATTER_MIN_R:
            rows.append(("relationship", "scatter", pair["a"], pair["b"], None, 6.0 + 4.0 * abs(pair["r"])))
    if len(measures) >= GRID_MIN_COLUMNS:
        rows.append(("correlations", "heatmap", ",".join(measures), None, None, 5.5 + min(len(measures) / 20.0, 0.5)))
    if primary:
        rows.append(("distribution", "histogram", primary, None, None, 4.0 + min(variation(known.facts.columns[primary]), 2.0)))
    if category:
        rows.append(("spread_by_group", "box", category, primary, None, 3.5))
    if time and len(measures) > 1:
        second = measures[1]
        rows.append(("trend_secondary", "line", time, second, default_aggregate(second),
                     3.0 + min(variation(known.facts.columns[second]), 1.5)))
    return df.sparkSession.createDataFrame(rows, CANDIDATE_SCHEMA).orderBy(F.desc("score"), "kind").limit(limit)
