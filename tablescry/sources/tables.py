"""Previews, writers, versions and the list of known tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.operators.profile import profile_table
from tablescry.operators.quality import health
from tablescry.operators.routing import route_profile

MAX_PREVIEW = 200


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first rows in the given order, with the table's size and whether it was cut.

    Planned as a bounded heap per task beside one count; no sort of the table.
    """
    n = max(1, min(MAX_PREVIEW, int(n)))  # total_rows and truncated tell what is not shown
    total = df.agg(F.count("*")).scalar()
    first = df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(n)
    return first.withColumn("total_rows", total).withColumn("truncated", F.col("total_rows") > n)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def as_records(df: DataFrame) -> DataFrame:
    """Values fit for JSON: NaN and infinities null, times as ISO-8601 text."""
    out = []
    for item in df.schema.fields:
        c = F.col(f"`{item.name}`")
        if isinstance(item.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(item.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        elif isinstance(item.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(item.name))
    return df.select(*out)


def write_records(df: DataFrame, path: str) -> None:
    as_records(df).write.mode("overwrite").json(path, ignoreNullFields=False)


def save_version(df: DataFrame, root: str, version: str) -> str:
    """Write one version beside the others; the original is never replaced."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists" if version == "original" else "overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The cleaned table if there is one, else the original; or the named version."""
    base = root.rstrip("/")
    if version:
        return spark.read.parquet(f"{base}/{version}")
    try:
        return spark.read.parquet(f"{base}/cleaned")
    except AnalysisException:
        return spark.read.parquet(f"{base}/original")


def dataset_summary(tables: dict[str, DataFrame], cleaned: Sequence[str] = ()) -> DataFrame:
    """One row per table: size, shape, health score and grade, newest (last given) first."""
    rows = []
    for place, (name, df) in enumerate(tables.items()):
        known = profile_table(df, "sketch", audit=True)
        report = health(df, known)[1].select("n_rows", "score", "grade")
        rows.append(report.select(
            F.lit(place).alias("added"), F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
            F.lit(route_profile(known).archetype).alias("archetype"), "score", "grade", F.lit(name in set(cleaned)).alias("is_cleaned"),
        ))
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("added"))
