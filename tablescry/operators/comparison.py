"""What changed between two tables, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescry.functions.scalars import pct_change
from tablescry.operators.profile import TableProfile, profile_table
from tablescry.operators.quality import health
from tablescry.operators.value_counts import value_counts
from tablescry.operators.aggregates import number_of

MAX_CHANGES = 12
MIN_VALUES = 5
MIN_PCT = 2.0
MIN_SHIFT = 3.0
ROWS_DIFFER = 0.02

CHANGE_SCHEMA = "kind string, column string, direction string, before double, after double, pct_change double, score double, names string"
CHANGE_COLUMNS = [item.split()[0] for item in CHANGE_SCHEMA.split(", ")]


def aligned_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two profiles matched by name, exactly and then by lower case.

    One row per column: its names and meanings on both sides, ``status`` of
    shared, removed or added, and whether the meaning changed.
    """
    left = a.select(F.col("column").alias("column_a"), F.col("semantic_type").alias("type_a"))
    right = b.select(F.col("column").alias("column_b"), F.col("semantic_type").alias("type_b"))
    exact = left.join(right, F.col("column_a") == F.col("column_b"))
    rest = left.join(exact.select("column_a"), "column_a", "left_anti")
    by_lower = right.groupBy(F.lower("column_b").alias("_lower")).agg(
        F.max_by("column_b", "column_b").alias("column_b"), F.max_by("type_b", "column_b").alias("type_b")
    )
    loose = rest.withColumn("_lower", F.lower("column_a")).join(by_lower, "_lower", "left").drop("_lower")
    matched = exact.unionByName(loose)
    added = right.join(matched.select("column_b"), "column_b", "left_anti").select(
        F.lit(None).cast("string").alias("column_a"), F.lit(None).cast("string").alias("type_a"), "column_b", "type_b"
    )
    return matched.unionByName(added).select(
        "column_a", "column_b", "type_a", "type_b",
        F.when(F.col("column_a").isNull(), "added").when(F.col("column_b").isNull(), "removed").otherwise("shared").alias("status"),
        F.coalesce(F.col("type_a") != F.col("type_b"), F.lit(False)).alias("type_conflict"),
    )


def matched_names(known_a: TableProfile, known_b: TableProfile) -> dict[str, str]:
    names_b = [c["column"] for c in known_b.columns]
    lower_b = {n.lower(): n for n in names_b}
    found = {}
    for c in known_a.columns:
        name = c["column"]
        match = name if name in names_b else lower_b.get(name.lower())
        if match:
            found[name] = match
    return found


def shape_changes(known_a: TableProfile, known_b: TableProfile, spark) -> DataFrame:
    """Row count, and which columns were gained or lost."""
    shared = matched_names(known_a, known_b)
    removed = sorted(c["column"] for c in known_a.columns if c["column"] not in shared)
    added = sorted(c["column"] for c in known_b.columns if c["column"] not in set(shared.values()))
    rows = []
    before, after = known_a.n_rows, known_b.n_rows
    if before != after:
        pct = 100.0 * (after - before) / before if before else None
        rows.append(("row_count", None, "up" if after > before else "down", float(before), float(after), pct, 95.0, None))
    if added:
        rows.append(("columns_added", None, "added", None, float(len(added)), None, 70.0, ", ".join(added)))
    if removed:
        rows.append(("columns_removed", None, "removed", float(len(removed)), None, None, 75.0, ", ".join(removed)))
    return spark.createDataFrame(rows, CHANGE_SCHEMA)


def _measure_stats(df: DataFrame, names: dict[str, str], side: str) -> DataFrame:
    """One row per measure from one aggregate over one scan."""
    row = df.agg(*[
        F.struct(
            F.lit(label).alias("column"), F.count(number_of(df, name)).alias(f"n_{side}"), F.sum(number_of(df, name)).alias(f"sum_{side}"),
            F.avg(number_of(df, name)).alias(f"mean_{side}"), F.stddev_samp(number_of(df, name)).alias(f"std_{side}"),
        ).alias(f"m{i}")
        for i, (label, name) in enumerate(names.items())
    ])
    return row.select(F.explode(F.array(*[F.col(f"m{i}") for i in range(len(names))])).alias("m")).select("m.*")


def measure_changes(a: DataFrame, b: DataFrame, measures: dict[str, str], rows_a: int, rows_b: int, strict: bool = False) -> DataFrame:
    """Moves of at least 2 % in each shared measure, and spread that moved alone.

    Averages are compared when the row counts differ by more than 2 %, totals
    otherwise. ``strict`` reports a spread only where the centre moved enough to
    be reported itself.
    """
    spark = a.sparkSession
    if not measures:
        return spark.createDataFrame([], CHANGE_SCHEMA)
    rows_differ = abs(rows_a - rows_b) / max(rows_a, 1) > ROWS_DIFFER
    left = _measure_stats(a, {n: n for n in measures}, "a")
    right = _measure_stats(b, measures, "b")
    both = left.join(F.broadcast(right), "column").where((F.col("n_a") >= MIN_VALUES) & (F.col("n_b") >= MIN_VALUES))  # a row per measure
    stat = "mean" if rows_differ else "sum"
    both = both.withColumns({
        "before": F.col(f"{stat}_a"),
        "after": F.col(f"{stat}_b"),
        "pct": pct_change(F.col(f"{stat}_a"), F.col(f"{stat}_b")),
        "spread_pct": pct_change(F.col("std_a"), F.col("std_b")),
    })
    direction = F.when(F.col("after") > F.col("before"), "up").otherwise("down")
    nobody = F.lit(None).cast("string").alias("names")
    moved = both.where(F.abs("pct") >= MIN_PCT).select(
        F.lit("measure").alias("kind"), "column", direction.alias("direction"), "before", "after",
        F.col("pct").alias("pct_change"), (40.0 + F.least(F.abs("pct"), F.lit(200.0)) / 4.0).alias("score"), nobody,
    )
    centre_still = (F.abs("pct") < 10.0) & ((F.abs("pct") >= MIN_PCT) if strict else F.lit(True))
    spread = both.where(centre_still & (F.abs("spread_pct") >= 25.0)).select(
        F.lit("spread").alias("kind"), "column", F.when(F.col("spread_pct") > 0, "up").otherwise("down").alias("direction"),
        F.col("std_a").alias("before"), F.col("std_b").alias("after"), F.col("spread_pct").alias("pct_change"),
        (35.0 + F.least(F.abs("spread_pct"), F.lit(100.0)) / 10.0).alias("score"), nobody,
    )
    return moved.unionByName(spread)


def category_shares(a: DataFrame, b: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(column, value, share_a, share_b) in percent of non-null rows, outer-matched."""
    left = _shares(value_counts(a, list(categories)), "a")
    renamed = b.select(*[F.col(f"`{name_b}`").alias(name_a) for name_a, name_b in categories.items()])
    right = _shares(value_counts(renamed, list(categories)), "b")
    return left.join(right, ["column", "value"], "full_outer")


def _shares(counts: DataFrame, side: str) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(  # a row per column
        "column", "value", (100.0 * F.col("n") / F.col("total")).alias(f"share_{side}")
    )


def category_changes(a: DataFrame, b: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Which values appeared or vanished, and the value with the largest shift in share, of 3 points or more."""
    spark = a.sparkSession
    if not categories:
        return spark.createDataFrame([], CHANGE_SCHEMA)
    delta = F.when(F.col("share_a").isNotNull() & F.col("share_b").isNotNull(), F.col("share_b") - F.col("share_a"))
    shift = F.when(F.abs(delta) >= MIN_SHIFT, F.struct(F.abs(delta).alias("size"), F.col("value"), F.col("share_a"), F.col("share_b"), delta.alias("delta")))
    summary = category_shares(a, b, categories).groupBy("column").agg(
        F.count_if(F.col("share_a").isNull()).alias("n_appeared"),
        F.count_if(F.col("share_b").isNull()).alias("n_vanished"),
        *(F.array_join(F.array_sort(F.collect_list(F.when(F.col(f"share_{side}").isNull(), F.col("value")))), ", ").alias(name)  # of a category: few values
          for side, name in (("a", "appeared"), ("b", "vanished"))),
        F.count("share_a").alias("n_a"),
        F.count("share_b").alias("n_b"),
        F.max(shift).alias("shift"),
    ).where("n_a > 0 and n_b > 0")
    none = F.lit(None).cast("double")
    appeared = summary.where("n_appeared > 0").select(
        F.lit("category_added").alias("kind"), "column", F.lit("added").alias("direction"), none.alias("before"),
        F.col("n_appeared").cast("double").alias("after"), none.alias("pct_change"), F.lit(55.0).alias("score"), F.col("appeared").alias("names"))
    vanished = summary.where("n_vanished > 0").select(
        F.lit("category_removed").alias("kind"), "column", F.lit("removed").alias("direction"),
        F.col("n_vanished").cast("double").alias("before"), none.alias("after"), none.alias("pct_change"), F.lit(58.0).alias("score"), F.col("vanished").alias("names"))
    shifted = summary.where("shift is not null").select(
        F.lit("category_shift").alias("kind"), "column", F.when(F.col("shift.delta") > 0, "up").otherwise("down").alias("direction"),
        F.col("shift.share_a").alias("before"), F.col("shift.share_b").alias("after"), F.col("shift.delta").alias("pct_change"),
        (45.0 + F.least("shift.size", F.lit(50.0)) / 2.0).alias("score"), F.col("shift.value").alias("names"))
    return reduce(DataFrame.unionByName, [appeared, vanished, shifted])


def quality_change(report_a: DataFrame, report_b: DataFrame) -> DataFrame:
    """A health score that moved by at least three points."""
    both = report_a.select(F.col("score").alias("before"), report_b.select("score").scalar().alias("after"))
    delta = F.col("after") - F.col("before")
    return both.where(F.abs(delta) >= 3).select(
        F.lit("quality").alias("kind"), F.lit(None).cast("string").alias("column"),
        F.when(delta > 0, "up").otherwise("down").alias("direction"), "before", "after", delta.alias("pct_change"),
        F.when(delta < 0, 85.0).otherwise(60.0).alias("score"), F.lit(None).cast("string").alias("names"),
    )


def compare(a: DataFrame, b: DataFrame, with_quality: bool = True, strict: bool = False, limit: int = MAX_CHANGES) -> DataFrame:
    """The ranked changes from ``a`` to ``b``; empty when no column is shared."""
    spark = a.sparkSession
    known_a = profile_table(a, "sketch", audit=with_quality)
    known_b = profile_table(b, "sketch", audit=with_quality)
    shared = matched_names(known_a, known_b)
    if not shared:
        return spark.createDataFrame([], CHANGE_SCHEMA)
    numeric = {n: shared[n] for n in known_a.of_type("numeric") if n in shared}
    categories = {n: shared[n] for n in known_a.of_type("categorical") if n in shared}
    parts = [
        shape_changes(known_a, known_b, spark),
        measure_changes(a, b, numeric, known_a.n_rows, known_b.n_rows, strict),
        category_changes(a, b, categories),
    ]
    if with_quality:
        parts.append(quality_change(health(a, known_a)[1], health(b, known_b)[1]))
    return rank_changes(reduce(DataFrame.unionByName, parts), limit)


def rank_changes(changes: DataFrame, limit: int = MAX_CHANGES) -> DataFrame:
    return changes.orderBy(F.desc("score"), "kind", "column").limit(limit)


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables share any column, and for each shared one how far its values meet.

    One row per column that either has, by lower-case name: whether both have it, the values
    that are there on each side, the different ones, and those found on both. Values are
    matched as text; each table is read once.
    """
    names_a, names_b = ({c.lower(): c for c in x.columns} for x in (a, b))
    shared = sorted(set(names_a) & set(names_b))
    every = [(name, name in names_a, name in names_b) for name in sorted(set(names_a) | set(names_b))]
    columns = a.sparkSession.createDataFrame(every, "column string, in_first boolean, in_second boolean")
    if shared:
        counts = [value_counts(x.select(*(F.col(f"`{names[c]}`").cast("string").alias(f"s{i}") for i, c in enumerate(shared))), [f"s{i}" for i in range(len(shared))])
                  .toDF("place", "value", f"n_{side}") for x, names, side in ((a, names_a, "a"), (b, names_b, "b"))]
        met = counts[0].join(counts[1], ["place", "value"], "full_outer").groupBy("place").agg(
            *(F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"n_{w}") for s, w in (("a", "first"), ("b", "second"))),
            *(F.count(f"n_{s}").alias(f"distinct_{w}") for s, w in (("a", "first"), ("b", "second"))),
            F.count(F.col("n_a") + F.col("n_b")).alias("distinct_common"))
        places = a.sparkSession.createDataFrame([(f"s{i}", c) for i, c in enumerate(shared)], "place string, column string")
        columns = columns.join(F.broadcast(met.join(F.broadcast(places), "place").drop("place")), "column", "left")  # a row per column
    else:
        columns = columns.withColumns({c: F.lit(None).cast("long") for c in ("n_first", "n_second", "distinct_first", "distinct_second", "distinct_common")})
    return columns.withColumn("comparable", F.lit(bool(shared)))
