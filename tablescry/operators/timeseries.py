"""Calendar resampling, trends, and series statistics.

Raw rows are only ever aggregated to one row per period with a map-side
combine. Windows run over periods, whose number the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescry.functions.names import NotCalculable, aggregate_column, aggregate_name, columns_of
from tablescry.operators.aggregates import keep_top_values, number_of, stamp_of
from tablescry.operators.quantiles import exact_quantiles
from tablescry.operators.value_counts import unpivoted

FREQUENCIES = ("D", "W", "M")
MAX_ENTITIES = 6
FLAT_BAND = 0.05


def _days_to_freq(days: Column) -> Column:
    return F.when(days <= 90, "D").when(days <= 800, "W").otherwise("M")


def suggest_freq(df: DataFrame, time: str) -> DataFrame:
    """D, W or M from the span of the dates; D for a column without dates."""
    stamp = stamp_of(df, time)
    span = df.agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    days = F.extract(F.lit("DAY"), F.col("last") - F.col("first"))  # whole days, free of clock changes
    return span.select("first", "last", days.cast("long").alias("span_days")).withColumn(
        "freq", F.when(F.col("span_days").isNull(), "D").otherwise(_days_to_freq(F.col("span_days")))
    )


def chosen_freq(df: DataFrame, time: str, freq: str | None) -> str:
    if freq:
        wanted = str(freq).strip().upper()
        if wanted not in FREQUENCIES:
            raise NotCalculable(f"time grouping must be one of {', '.join(FREQUENCIES)}")
        return wanted
    return suggest_freq(df, time).first()["freq"]


def period_of(stamp: Column, freq: str) -> Column:
    """The label of a date's period: the day, the week's Sunday, the month's end."""
    day = F.to_date(stamp)
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SU")
    return F.last_day(day)


def _period_after(period: Column, freq: str) -> Column:
    if freq == "D":
        return F.date_add(period, 1)
    if freq == "W":
        return F.date_add(period, 7)
    return F.last_day(F.add_months(F.trunc(period, "MM"), 1))


def _periods_between(first: Column, last: Column, freq: str) -> Column:
    if freq == "D":
        return F.sequence(first, last, F.expr("interval 1 day"))
    if freq == "W":
        return F.sequence(first, last, F.expr("interval 7 day"))
    starts = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    return F.transform(starts, lambda d: F.last_day(d))


def complete_calendar(periods: DataFrame, freq: str, values: Sequence[str], keys: Sequence[str] = (), zero: Sequence[str] = ()) -> DataFrame:
    """Add the empty periods between a series' first and last one.

    Each observed period is spread up to the day before the next observed one,
    so the gaps are filled without building a calendar and joining it.
    """
    order = Window.partitionBy(*columns_of(keys)).orderBy("period") if keys else Window.partitionBy(F.lit(1)).orderBy("period")
    upcoming = F.lead("period").over(order)
    last_of_gap = F.coalesce(F.col("_next"), _period_after(F.col("period"), freq))
    spread = (
        periods.withColumn("_next", upcoming)
        .withColumn("_slots", _periods_between(F.col("period"), last_of_gap, freq))
        .withColumn("_slots", F.slice("_slots", F.lit(1), F.greatest(F.size("_slots") - 1, F.lit(1))))
        .withColumn("_observed", F.col("period"))
        .withColumn("period", F.explode("_slots"))
    )
    kept = [
        (F.when(F.col("period") == F.col("_observed"), F.col(v)).otherwise(F.lit(0) if v in zero else F.lit(None))).alias(v)
        for v in values
    ]
    return spread.select(*keys, "period", *kept)


def resample(
    df: DataFrame, time: str, measure: str, freq: str | None = None, agg: str = "mean", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, period, value) on a complete D/W/M grid.

    A period without rows is null, except that a sum or a count of nothing is 0.
    """
    agg, freq = aggregate_name(agg), chosen_freq(df, time, freq)
    rows = df.select(
        *[F.col(f"`{k}`") for k in keys], period_of(stamp_of(df, time), freq).alias("period"), number_of(df, measure).alias("v")
    ).where(F.col("period").isNotNull() & F.col("v").isNotNull())
    if agg == "median":
        observed = exact_quantiles(rows, [*keys, "period"], [0.5]).select(*keys, "period", F.col("q").alias("value"))
    else:
        observed = rows.groupBy(*columns_of(keys), "period").agg(aggregate_column(F.col("v"), agg).cast("double").alias("value"))
    zero = ["value"] if agg in ("sum", "count") else []
    return complete_calendar(observed, freq, ["value"], keys, zero).withColumn("value", F.col("value").cast("double"))


def rolling_mean(series: DataFrame, window: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """Trailing mean over the last ``window`` periods, empty periods skipped."""
    if window < 1:
        raise NotCalculable("the rolling window must hold at least one period")
    frame = Window.partitionBy(*(columns_of(keys) or [F.lit(1)])).orderBy("period").rowsBetween(-(window - 1), 0)
    return series.withColumn("rolling_mean", F.avg("value").over(frame))


def resample_by_entity(df: DataFrame, time: str, measure: str, entity: str, freq: str = "D", k: int = MAX_ENTITIES) -> DataFrame:
    """Mean per period of the k categories with the most usable rows; observed periods only."""
    usable = df.where(
        stamp_of(df, time).isNotNull() & number_of(df, measure).isNotNull() & F.col(f"`{entity}`").isNotNull()
    )
    top = keep_top_values(usable, entity, k)
    return (
        top.select(F.col(f"`{entity}`").cast("string").alias("entity"), period_of(stamp_of(df, time), freq).alias("period"),
                   number_of(df, measure).alias("v"))
        .groupBy("entity", "period").agg(F.avg("v").alias("value"), F.count("v").alias("rows"))
    )


def _ranked(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed periods with their place and the series' length."""
    part = Window.partitionBy(*(columns_of(keys) or [F.lit(1)]))
    return (
        series.where("value is not null")
        .withColumn("i", F.row_number().over(part.orderBy("period")) - 1)
        .withColumn("n_periods", F.count("*").over(part))
    )


def trend_slope(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope per period; flat when the fitted change is under 5 % of the scale."""
    fit = _ranked(series, keys).groupBy(*columns_of(keys)).agg(
        F.regr_slope("value", "i").alias("slope"),
        F.count("*").alias("n_periods"),
        F.avg("value").alias("_mean"),
        F.stddev_samp("value").alias("_std"),
    )
    scale = F.when(F.abs("_mean") > 1e-12, F.abs("_mean")).when(F.col("_std") > 1e-12, F.col("_std")).otherwise(F.lit(1.0))
    change = F.col("slope") * (F.col("n_periods") - 1)
    return fit.select(
        *keys,
        F.when(F.col("n_periods") < 2, "unknown")
        .when(F.abs(change) < FLAT_BAND * scale, "flat")
        .when(change > 0, "rising")
        .otherwise("falling").alias("direction"),
        F.when(F.col("n_periods") >= 2, F.col("slope")).alias("slope"),
        "n_periods",
    )


def trend_thirds(series: DataFrame, keys: Sequence[str] = (), min_periods: int = 3) -> DataFrame:
    """First third against last third of the observed periods, with peak and low."""
    third = F.greatest(F.floor(F.col("n_periods") / 3), F.lit(1))
    return (
        _ranked(series, keys)
        .groupBy(*columns_of(keys))
        .agg(
            F.count("*").alias("n_periods"),
            F.avg(F.when(F.col("i") < third, F.col("value"))).alias("start_average"),
            F.avg(F.when(F.col("i") >= F.col("n_periods") - third, F.col("value"))).alias("end_average"),
            F.max_by("period", F.struct(F.col("value"), -F.col("i"))).alias("peak_period"),
            F.max("value").alias("peak_value"),
            F.min_by("period", F.struct("value", "i")).alias("low_period"),
            F.min("value").alias("low_value"),
            F.min("period").alias("first_period"),
            F.max("period").alias("last_period"),
        )
        .where(F.col("n_periods") >= min_periods)
        .withColumn(
            "change_pct",
            F.when(
                F.col("start_average") != 0,
                100.0 * (F.col("end_average") - F.col("start_average")) / F.abs("start_average"),
            ).otherwise(F.lit(0.0)),
        )
        .withColumn("direction", F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("flat"))
    )


def series_stats(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of the resampled series, as drawn: per period, not per row."""
    return series.groupBy(*columns_of(keys)).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(F.lit(0.0)).alias("std"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count("*").alias("n_periods"),
        F.count("value").alias("n_observed"),
    )


def forecast_readiness(df: DataFrame, time: str, target: str, days_needed: int = 30) -> DataFrame:
    """Whether enough days carry a value to train and to score a forecast."""
    day = F.to_date(stamp_of(df, time))
    days = df.select(day.alias("day"), number_of(df, target).alias("v")).where("day is not null and v is not null")
    return (
        days.groupBy("day").agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("days_observed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        .withColumn("days_needed", F.lit(days_needed))
        .withColumn("ready", F.col("days_observed") >= days_needed)
    )


def trends(df: DataFrame, time: str, measures: list[str], freq: str | None = None, min_periods: int = 6, min_pct: float = 5.0) -> DataFrame:
    """Trends of several measures out of one scan, where they moved by at least ``min_pct``."""
    freq = chosen_freq(df, time, freq)
    period = period_of(stamp_of(df, time), freq)
    wide = (
        df.select(period.alias("period"), *[number_of(df, m).alias(m) for m in measures])
        .where("period is not null")
        .groupBy("period")
        .agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in measures])
    )
    long = unpivoted(wide, dict(zip(measures, columns_of(measures))), {"period": F.col("period")}, "measure")
    return trend_thirds(long, ["measure"], min_periods).where(
        (F.col("start_average") != 0) & (F.abs("change_pct") >= min_pct)
    ).withColumn("freq", F.lit(freq))
