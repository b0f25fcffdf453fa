"""Ranked findings over a whole table, and the short briefing made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescry.operators.aggregates import segments
from tablescry.operators.anomalies import anomalies
from tablescry.operators.correlation import relationships
from tablescry.operators.profile import TableProfile, profile_table
from tablescry.operators.quality import data_issue_findings
from tablescry.operators.routing import Routing, finding_categories, finding_measures, route_profile
from tablescry.operators.timeseries import forecast_readiness, trends

MAX_FINDINGS = 12
MAX_POINTS = 5

FINDING_COLUMNS = ("kind", "subject", "other", "direction", "value", "baseline", "comparison", "n", "score")
FINDING_SCHEMA = (
    "kind string, subject string, other string, direction string, value double, baseline double, "
    "comparison double, n long, score double"
)


def _as_findings(df: DataFrame, kind: str, **columns) -> DataFrame:
    parts = {"kind": F.lit(kind), **columns}
    types = dict(item.split() for item in FINDING_SCHEMA.split(", "))
    return df.select(*[parts.get(name, F.lit(None)).cast(types[name]).alias(name) for name in FINDING_COLUMNS])


def all_findings(
    df: DataFrame, known: TableProfile | None = None, roles: Routing | None = None, n_duplicates: int | None = None
) -> DataFrame:
    """Everything found, unranked: trends, relationships, anomalies, segments,
    forecast readiness and data problems, with the score each earns."""
    known = known or profile_table(df, "sketch")
    roles = roles or route_profile(known)
    measures = finding_measures(df, known)
    categories = finding_categories(known)
    target = roles.target_col or (measures[0] if measures else None)
    found = [df.sparkSession.createDataFrame([], FINDING_SCHEMA)]

    if roles.time_col and measures:
        t = trends(df, roles.time_col, measures)
        found.append(_as_findings(
            t, "trend", subject=F.col("measure"), other=F.lit(roles.time_col), direction=F.col("direction"),
            value=F.col("change_pct"), baseline=F.col("start_average"), comparison=F.col("end_average"),
            n=F.col("n_periods"), score=F.least(F.abs("change_pct"), F.lit(200.0)),
        ))
    if len(measures) >= 2:
        r = relationships(df, measures, k=None)
        found.append(_as_findings(
            r, "relationship", subject=F.col("a"), other=F.col("b"),
            direction=F.when(F.col("r") > 0, "same direction").otherwise("opposite directions"),
            value=F.col("r"), n=F.col("n"), score=60.0 * F.abs("r"),
        ))
    if measures:
        a = anomalies(df, measures, known=known)
        found.append(_as_findings(
            a, "anomaly", subject=F.col("measure"), value=F.col("value"), baseline=F.col("typical"),
            comparison=F.col("share_pct"), n=F.col("n_unusual"), score=40.0 + F.least("share_pct", F.lit(20.0)),
        ))
    if measures and categories and target:
        chosen = target if target in measures else measures[0]
        s = segments(df, categories, chosen)
        found.append(_as_findings(
            s, "segment", subject=F.col("best_group"), other=F.col("category"), direction=F.lit("above"),
            value=F.col("gap_pct"), baseline=F.col("overall_average"), comparison=F.col("best_average"),
            n=F.col("best_rows"), score=30.0 + F.least(F.abs("gap_pct"), F.lit(30.0)),
        ))
    if roles.time_col and target:
        f = forecast_readiness(df, roles.time_col, target).where("days_observed > 0")
        found.append(_as_findings(
            f, "forecast", subject=F.lit(target), other=F.lit(roles.time_col),
            direction=F.when(F.col("ready"), "ready").otherwise("too short"), value=F.col("days_observed"),
            baseline=F.col("days_needed"), n=F.col("days_observed"), score=F.when(F.col("ready"), 45.0).otherwise(8.0),
        ))
    d = data_issue_findings(df, known, n_duplicates)
    found.append(_as_findings(
        d, "quality", subject=F.col("subject"), other=F.col("issue"), value=F.col("value"), n=F.col("n"), score=F.col("score"),
    ))
    return reduce(DataFrame.unionByName, found)


def ranked_findings(found: DataFrame, limit: int = MAX_FINDINGS) -> DataFrame:
    """The best findings of all passes against each other.

    Of the relationships only the three strongest compete; a table with dozens
    of linked pairs has other things to say too.
    """
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "subject", "other"))
    return (
        found.withColumn("_place", place)
        .where((F.col("kind") != "relationship") | (F.col("_place") <= 3))
        .drop("_place")
        .orderBy(F.desc("score"), "kind", "subject", "other")
        .limit(limit)
    )


def findings(df: DataFrame, known: TableProfile | None = None, roles: Routing | None = None) -> DataFrame:
    return ranked_findings(all_findings(df, known, roles))


def finding_counts(found: DataFrame) -> DataFrame:
    """How many of each kind were found, listed or not; anomalies count rows."""
    return found.groupBy("kind").agg(
        F.sum(F.when(F.col("kind") == "anomaly", F.col("n")).when((F.col("kind") == "forecast") & (F.col("direction") != "ready"), F.lit(0)).otherwise(F.lit(1))).alias("n_found")
    )


def briefing(listed: DataFrame, issues: DataFrame, report: DataFrame, known: TableProfile, limit: int = MAX_POINTS) -> DataFrame:
    """The few points to read first.

    Up to two critical issues lead, then the findings in their order, then one
    line on quality when nothing is critical, then the shape of the table.
    """
    spark = listed.sparkSession
    schema = "kind string, subject string, value double, score double"
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    one = Window.partitionBy(F.lit(1))  # issues and findings are a few dozen rows
    serious = (
        issues.withColumn("place", F.row_number().over(one.orderBy(rank, F.desc("pct_affected"), "id")) - 1)
        .where((F.col("severity") == "critical") & (F.col("place") < 2))
        .select(F.lit("issue").alias("kind"), F.col("id").alias("subject"), F.col("pct_affected").alias("value"),
                (200.0 - F.col("place")).alias("score"))
    )
    cards = listed.withColumn("place", F.row_number().over(one.orderBy(F.desc("score"), "kind", "subject", "other")) - 1).select(
        "kind", "subject", "value", (100.0 - F.col("place")).alias("score")
    )
    quality = report.where("n_critical = 0").select(
        F.lit("quality").alias("kind"), F.col("grade").alias("subject"), F.col("score").alias("value"), F.lit(40.0).alias("score")
    )
    shape = spark.createDataFrame([("shape", f"{known.n_rows} rows, {len(known.columns)} columns", float(known.n_rows), 30.0)], schema)
    return reduce(DataFrame.unionByName, [serious, cards, quality, shape]).orderBy(F.desc("score")).limit(limit)
