"""Rows far outside the usual range of a measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescry.operators.aggregates import number_of, outside
from tablescry.operators.profile import TableProfile, profile_table
from tablescry.operators.quality import FENCE, fences
from tablescry.operators.quantiles import exact_quantiles

MIN_MEASURE_ROWS = 20
MIN_ROWS = 10

ANOMALY_SCHEMA = (
    "n_unusual long, share_pct double, rows_scanned long, measure string, row_key string, value double, "
    "typical double, usual_low double, usual_high double, n_outside long"
)


def anomalies(df: DataFrame, measures: Sequence[str], key: Sequence[str] = (), known: TableProfile | None = None) -> DataFrame:
    """Rows beyond the fence of at least one measure (0 or 1 row).

    Reports how many there are, their share, and the single most extreme value
    with the range most values lie in. After the quantiles one scan answers all
    measures together.
    """
    measures = list(measures)
    if known is None or known.facts is None:
        known = profile_table(df.select(*[F.col(f"`{m}`") for m in measures]), "sketch")
    bounds = fences(df, measures, known, MIN_MEASURE_ROWS)
    spark = df.sparkSession
    if not bounds:
        return spark.createDataFrame([], ANOMALY_SCHEMA)
    names = list(bounds)
    any_odd = F.lit(False)
    wanted = [F.count("*").alias("n_rows")]
    for i, name in enumerate(names):
        odd = outside(number_of(df, name), bounds[name]["low"], bounds[name]["high"])
        any_odd = any_odd | odd
        wanted.append(F.count_if(odd).alias(f"n{i}"))
    row = df.agg(*wanted, F.count_if(any_odd).alias("n_unusual")).first()
    # The value farthest from the median is the lowest or the highest one; ties go low.
    flagged = []
    for i, name in enumerate(names):
        facts, middle = known.facts.columns[name], bounds[name]["median"]
        if row[f"n{i}"]:
            value = facts["min"] if middle - facts["min"] >= facts["max"] - middle else facts["max"]
            flagged.append((abs(value - middle), -i, value))
    if not flagged:
        return spark.createDataFrame([], ANOMALY_SCHEMA)
    _, minus_place, value = max(flagged)
    worst, b = names[-minus_place], bounds[names[-minus_place]]
    row_key = None
    if key:
        named = F.col(f"`{key[0]}`").cast("string") if len(key) == 1 else F.to_json(F.struct(*[F.col(f"`{k}`") for k in key]))
        row_key = df.where(number_of(df, worst) == value).agg(F.min(named).alias("k")).first()["k"]
    share = 100.0 * row["n_unusual"] / max(1, row["n_rows"])
    return spark.createDataFrame(
        [(row["n_unusual"], share, row["n_rows"], worst, row_key, value, b["median"], b["p10"], b["p90"], row[f"n{-minus_place}"])],
        ANOMALY_SCHEMA,
    )


def unusual_rows(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The rows themselves that lie beyond the fence of any of the measures."""
    known = profile_table(df.select(*[F.col(f"`{m}`") for m in measures]), "sketch")
    odd = F.lit(False)
    for name, b in fences(df, measures, known, MIN_MEASURE_ROWS).items():
        odd = odd | outside(number_of(df, name), b["low"], b["high"])
    return df.where(odd)


def outlier_rows(df: DataFrame, measure: str, key: Sequence[str], n: int = 5) -> DataFrame:
    """The n rows farthest from the median, with the usual range and the count beyond the fence."""
    n = max(1, int(n))
    value = number_of(df, measure)
    present = df.select(*[F.col(f"`{k}`") for k in key], value.alias("value")).where("value is not null")
    pairs = present.select(F.col("value").alias("v"))
    q = {row["p"]: row["q"] for row in exact_quantiles(pairs, [], [0.1, 0.25, 0.5, 0.75, 0.9]).collect()}
    if not q:
        return present.limit(0)
    spread = q[0.75] - q[0.25]
    low, high = q[0.25] - FENCE * spread, q[0.75] + FENCE * spread
    odd = outside(F.col("value"), low, high) if spread > 0 else F.lit(False)
    counts = present.agg(F.struct(F.count("*").alias("n_values"), F.count_if(odd).alias("n_unusual"))).scalar()
    return (
        present.withColumn("difference", F.col("value") - q[0.5])
        .orderBy(F.desc(F.abs("difference")), *[F.col(f"`{k}`") for k in key])
        .limit(n)
        .withColumn("counts", counts)
        .where(F.col("counts.n_values") >= MIN_ROWS)
        .select(*[F.col(f"`{k}`") for k in key], "value", "difference", F.lit(q[0.5]).alias("typical"),
                F.lit(q[0.1]).alias("usual_low"), F.lit(q[0.9]).alias("usual_high"), "counts.n_unusual")
    )
