"""Whole-column and grouped summaries, and the filters that report their losses."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescry.functions.names import (
    NotCalculable,
    accumulates,
    aggregate_column,
    aggregate_name,
    resolve_column,
)
from tablescry.functions.scalars import is_numeric_type, percent, present, strip_ws, to_number, to_stamp
from tablescry.operators.profile import TableProfile, kind_counts, profile_table
from tablescry.operators.quantiles import exact_quantiles, quantile_rows
from tablescry.operators.routing import chart_categories, chart_measures, route_profile
from tablescry.operators.value_counts import category_counts, unpivoted, value_counts


def number_of(df: DataFrame, name: str) -> Column:
    return to_number(F.col(f"`{name}`"), df.schema[name].dataType)


def stamp_of(df: DataFrame, name: str) -> Column:
    return to_stamp(F.col(f"`{name}`"), df.schema[name].dataType)


def drop_unusable(df: DataFrame, needed: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Keep rows where every needed expression has a value, and count the losses.

    Returns the projected, filtered rows and a one-row report with the number of
    rows seen, kept, and missing per expression.
    """
    projected = df.select(*[expression.alias(name) for name, expression in needed.items()])
    complete = F.lit(True)
    for name in needed:
        complete = complete & F.col(name).isNotNull()
    report = projected.agg(
        F.count("*").alias("n_rows"),
        F.count_if(complete).alias("n_used"),
        *[F.count_if(F.col(name).isNull()).alias(f"n_bad_{name}") for name in needed],
    )
    return projected.where(complete), report


def aggregate(df: DataFrame, measure: str, agg: str = "mean") -> DataFrame:
    """One number for a whole column, with the rows used and left out."""
    measure, agg = resolve_column(df, measure, "the measure"), aggregate_name(agg)
    values = df.select(number_of(df, measure).alias("v"))
    if agg == "median":
        counted = values.agg(F.count("v").alias("rows_used"), F.count_if(F.col("v").isNull()).alias("rows_excluded"))
        median = exact_quantiles(values.where("v is not null"), [], [0.5]).select("q")
        return counted.select(median.scalar().alias("value"), "rows_used", "rows_excluded")
    return values.agg(
        aggregate_column(F.col("v"), agg).cast("double").alias("value"),
        F.count("v").alias("rows_used"),
        F.count_if(F.col("v").isNull()).alias("rows_excluded"),
    )


def grouped_summary(df: DataFrame, group: str, measure: str, agg: str = "mean") -> DataFrame:
    """(group, value, rows) for every group that has a usable value."""
    pairs = df.select(F.col(f"`{group}`").cast("string").alias("group"), number_of(df, measure).alias("v")).where(
        F.col("group").isNotNull()
    )
    if agg == "median":
        used = pairs.where("v is not null")
        counts = used.groupBy("group").agg(F.count("*").alias("rows"))
        return exact_quantiles(used, ["group"], [0.5]).join(counts, "group").select("group", F.col("q").alias("value"), "rows")
    return (
        pairs.groupBy("group")
        .agg(aggregate_column(F.col("v"), agg).cast("double").alias("value"), F.count("v").alias("rows"))
        .where("value is not null")
    )


def rank_groups(
    df: DataFrame, group: str, measure: str, agg: str = "mean", n: int = 10, order: str = "top"
) -> DataFrame:
    """The n highest or lowest groups on a measure with the number of groups; ties go to the smaller group name."""
    group = resolve_column(df, group, "the grouping")
    measure = resolve_column(df, measure, "the measure")
    n = max(1, int(n))
    ascending = str(order).lower() in ("bottom", "lowest", "worst", "asc")
    summary = grouped_summary(df, group, measure, aggregate_name(agg))
    by = F.asc("value") if ascending else F.desc("value")
    return summary.orderBy(by, "group").limit(n).withColumn("n_groups", summary.agg(F.count("*")).scalar())


def count_where(df: DataFrame, column: str | None = None, value: object = None) -> DataFrame:
    """Rows whose value matches, whatever its case and outer white space."""
    if not column or value is None:
        return df.agg(F.count("*").alias("matching_rows"), F.count("*").alias("total_rows")).withColumn(
            "share_pct", F.lit(100.0)
        )
    column = resolve_column(df, column, "the column to filter on")
    wanted = str(value).strip().lower()
    text = F.lower(strip_ws(present(F.col(f"`{column}`"), df.schema[column].dataType).cast("string")))
    return df.agg(F.count_if(text == wanted).alias("matching_rows"), F.count("*").alias("total_rows")).withColumn(
        "share_pct", percent(F.col("matching_rows"), F.greatest("total_rows", F.lit(1)))
    )


def in_time_range(df: DataFrame, time: str, start: date | datetime | str, end: date | datetime | str) -> DataFrame:
    """Rows with a date in [start, end]. On a native timestamp the bounds reach the scan."""
    start, end = datetime.fromisoformat(str(start)), datetime.fromisoformat(str(end))
    if start > end:
        raise NotCalculable(f"the time range starts at {start} after it ends at {end}")
    stamp = stamp_of(df, time)
    low, high = (F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz") for bound in (start, end))
    return df.where((stamp >= low) & (stamp <= high))


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """True where a present value lies beyond a bound; null stays inside."""
    odd = F.lit(False)
    if low is not None:
        odd = odd | (value < low)
    if high is not None:
        odd = odd | (value > high)
    return F.coalesce(odd, F.lit(False))


def keep_top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows of the k most frequent values. The list has k rows, so it is broadcast."""
    top = category_counts(df, column, k).select(F.col("value").alias("_top"))
    return df.join(F.broadcast(top), F.col(f"`{column}`").cast("string") == F.col("_top"), "left_semi")


def describe_number(df: DataFrame, column: str) -> DataFrame:
    """Lowest, highest, average, middle value, distinct and missing counts."""
    column = resolve_column(df, column)
    data_type = df.schema[column].dataType
    raw, value = present(F.col(f"`{column}`"), data_type), number_of(df, column)
    base = df.agg(
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(value).alias("average"),
        F.count_if(raw.isNull()).alias("missing_rows"),
        F.count("*").alias("n_rows"),
    ).withColumn("missing_pct", percent(F.col("missing_rows"), F.greatest("n_rows", F.lit(1)))).drop("n_rows")
    distinct = df.agg(F.count_distinct(raw).alias("distinct_values"))
    middle = exact_quantiles(df.select(value.alias("v")).where("v is not null"), [], [0.5])
    return base.withColumns({"distinct_values": distinct.scalar(), "typical": middle.select("q").scalar()})


def describe_category(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most common values with the column's distinct and missing counts."""
    column = resolve_column(df, column)
    counts = value_counts(df, [column])
    missing = df.agg(F.struct(F.count_if(F.col(f"`{column}`").isNull()).alias("rows"), F.count("*").alias("n_rows"))).scalar()
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.select(
        "value", "n", counts.agg(F.count("*")).scalar().alias("distinct_values"), missing.alias("_m")
    ).select(
        "value", "n", "distinct_values", F.col("_m.rows").alias("missing_rows"),
        percent(F.col("_m.rows"), F.greatest("_m.n_rows", F.lit(1))).alias("missing_pct"),
    )


def describe_column(df: DataFrame, column: str, known: TableProfile | None = None) -> DataFrame:
    """Numbers get their range, everything else its most common values."""
    column = resolve_column(df, column)
    kind = (known or profile_table(df.select(f"`{column}`"), "sketch")).kind(column)
    return describe_number(df, column) if kind in ("numeric", "geo_lat", "geo_lon") else describe_category(df, column)


def summary_stats(df: DataFrame, measure: str) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum."""
    values = df.select(number_of(df, measure).alias("v")).where("v is not null")
    base = values.agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_quantiles(values, [], [0.25, 0.5, 0.75]).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("q50"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q75"),
    )
    at = quartiles.select(F.struct("q25", "q50", "q75")).scalar()
    return base.select("*", at.alias("_q")).select("count", "mean", "std", "min", "max", "_q.*")


def quantiles(df: DataFrame, measures: list[str], probabilities: list[float]) -> DataFrame:
    """Exact quantiles of several measures as (measure, p, q)."""
    return quantile_rows(df, {m: number_of(df, m) for m in measures}, probabilities)


def overview(df: DataFrame) -> DataFrame:
    """What the table is: size, kinds of column, period covered and column roles."""
    known = profile_table(df, "sketch")
    roles = route_profile(known)
    kinds = kind_counts(known)
    covers = None
    if roles.time_col:
        c = known.column(roles.time_col)
        if c.get("min_date") and c.get("max_date"):
            covers = f"{c['min_date'][:10]} to {c['max_date'][:10]}"
    row = (
        known.n_rows, len(df.columns), kinds["datetime"], kinds["numeric"], kinds["categorical"],
        kinds["geo_lat"] + kinds["geo_lon"], kinds["text"], covers, roles.target_col, roles.entity_col, roles.archetype,
    )
    return df.sparkSession.createDataFrame(
        [row],
        "n_rows long, n_cols int, n_datetime int, n_numeric int, n_categorical int, n_geo int, n_text int, "
        "covers string, main_measure string, grouped_by string, shaped_as string",
    )


def kpis(df: DataFrame, known: TableProfile | None = None) -> DataFrame:
    """Headline numbers: size, period, two leading measures, and for a table with
    fewer than four of those the vocabulary of its first category with its most common
    value. At most five."""
    known = known or profile_table(df, "sketch")
    roles = route_profile(known)
    measures = chart_measures(known, roles.target_col)
    categories = chart_categories(known)
    cards: list[tuple] = [
        ("Rows", None, float(known.n_rows), None, None, "shape"),
        ("Columns", None, float(len(df.columns)), None, None, "shape"),
    ]
    if roles.time_col:
        dates = known.facts.columns[roles.time_col]
        if dates["min_date"] and dates["n_dates"] > 1:
            days = float((dates["max_date"] - dates["min_date"]).days)
            cards.append(("Covers days", roles.time_col, days, None, None, "time"))
    totals = None
    if measures:
        row = df.agg(*[F.sum(number_of(df, m)).alias(f"s{i}") for i, m in enumerate(measures[:2])]).first()
        totals = dict(zip(measures[:2], row))
    for m in measures[:2]:
        facts = known.facts.columns[m]
        if not facts["n_numbers"]:
            continue
        total = accumulates(m)
        cards.append((
            "Total" if total else "Average", m, totals[m] if total else facts["mean"], facts["min"], facts["max"], "measure",
        ))
    most = (None, None)
    if len(cards) < 4 and categories:
        c = known.column(categories[0])
        cards.append(("Distinct", categories[0], float(c["n_unique"]), None, None, "category"))
        top = category_counts(df, categories[0], 1).first()
        most = (str(top["value"]), top["n"]) if top else most
    rows = [(i + 1, *card, *(most if card[-1] == "category" else (None, None))) for i, card in enumerate(cards[:5])]
    return df.sparkSession.createDataFrame(
        rows, "position int, label string, column string, value double, lowest double, highest double, kind string, most_common string, most_common_rows long"
    )


def segments(df: DataFrame, categories: list[str], target: str, min_rows: int = 3, min_gap_pct: float = 3.0) -> DataFrame:
    """Best and worst group per category against the overall mean of the target.

    One scan groups all categories at once; groups below ``min_rows`` do not
    count, and a category is reported when its best group is at least
    ``min_gap_pct`` away from the mean.
    """
    stacked = unpivoted(df, {c: F.col(f"`{c}`").cast("string") for c in categories}, {"_v": number_of(df, target)}, "category")
    groups = stacked.groupBy("category", "value").agg(
        F.avg("_v").alias("mean"), F.sum("_v").alias("total"), F.count("_v").alias("n")
    )
    counted = F.col("value").isNotNull() & (F.col("n") >= min_rows)
    best = F.struct(F.col("mean"), F.col("value"), F.col("n"))
    per_category = groups.groupBy("category").agg(
        (F.sum("total") / F.sum("n")).alias("overall_average"),
        F.count_if(counted).alias("n_groups"),
        F.max_by(best, F.when(counted, F.struct(F.col("mean"), F.col("value")))).alias("best"),
        F.min_by(best, F.when(counted, F.struct(F.col("mean"), F.col("value")))).alias("worst"),
    )
    gap = 100.0 * (F.col("best.mean") - F.col("overall_average")) / F.abs("overall_average")
    return (
        per_category.where((F.col("n_groups") >= 2) & (F.col("overall_average") != 0))
        .withColumn("gap_pct", gap)
        .where(F.abs("gap_pct") >= min_gap_pct)
        .select(
            "category",
            F.lit(target).alias("measure"),
            F.col("best.value").alias("best_group"),
            F.col("best.mean").alias("best_average"),
            F.col("best.n").alias("best_rows"),
            F.col("worst.value").alias("worst_group"),
            F.col("worst.mean").alias("worst_average"),
            F.col("worst.n").alias("worst_rows"),
            "overall_average",
            "n_groups",
            "gap_pct",
        )
    )


def row_sample(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """A repeatable sample of n rows, chosen by a seeded hash of the key columns.

    The n lowest hashes win, so the choice depends on neither file order nor
    the number of partitions. Nothing in the library samples unless asked to.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]), *[F.col(f"`{k}`") for k in key]).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
