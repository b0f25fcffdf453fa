"""What-if projections: move a measure, or what drives it, by a percentage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescry.functions.names import is_identifier, resolve_column
from tablescry.operators.aggregates import number_of
from tablescry.operators.correlation import correlation_pairs, strength
from tablescry.operators.profile import TableProfile, profile_table
from tablescry.operators.routing import route_profile

MIN_PCT, MAX_PCT = -90.0, 200.0
MIN_R, MIN_ROWS, MIN_DISTINCT = 0.3, 20, 5


def movable_columns(known: TableProfile) -> list[str]:
    """Numbers that are no identifiers, with 20 values and more than five kinds of them."""
    return [
        c["column"]
        for c in known.columns
        if c["semantic_type"] == "numeric"
        and not is_identifier(c["column"])
        and known.facts.columns[c["column"]]["n_numbers"] >= MIN_ROWS
        and c["n_unique"] > MIN_DISTINCT
    ]


def driver_links(df: DataFrame, candidates: list[str], target: str) -> DataFrame:
    """(driver, r, n) of every candidate with the target, all in one scan."""
    others = [c for c in candidates if c != target]
    pairs = correlation_pairs(df, [target, *others])
    return pairs.where((F.col("a") == target) | (F.col("b") == target)).select(
        F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("driver"), "r", "n"
    )


def drivers(df: DataFrame, target: str | None = None, known: TableProfile | None = None) -> DataFrame:
    """Movable columns with their link to the target; the suggested one is flagged."""
    known = known or profile_table(df, "sketch")
    movable = movable_columns(known)
    wanted = target or route_profile(known).target_col
    target = wanted if wanted in movable else (movable[0] if movable else None)
    if target is None:
        return df.sparkSession.createDataFrame([], "target string, driver string, r double, n long, suggested boolean")
    links = driver_links(df, movable, target)
    best = links.where((F.col("n") >= MIN_ROWS) & (F.abs("r") > MIN_R)).orderBy(F.desc(F.abs("r")), "driver").limit(1).select(
        F.col("driver").alias("_best"))
    return links.join(F.broadcast(best), F.col("driver") == F.col("_best"), "left").select(
        F.lit(target).alias("target"), "driver", "r", "n", F.col("_best").isNotNull().alias("suggested"))


def simulate(df: DataFrame, target: str, pct: float, driver: str | None = None) -> DataFrame:
    """Project the target after moving the driver (itself by default) by ``pct`` percent.

    Through a driver the shift is the fitted slope times the driver's mean move.
    ``status`` is unsupported for a link too weak (r under 0.3) or too short
    (under 20 rows) to carry a projection; the projection is null then.
    """
    target = resolve_column(df, target, "the target")
    driver = resolve_column(df, driver, "the driver") if driver else target
    pct = float(max(MIN_PCT, min(MAX_PCT, float(pct))))
    factor = 1.0 + pct / 100.0
    y = number_of(df, target)
    base = [F.sum(y).alias("base_total"), F.avg(y).alias("base_average"), F.count(y).alias("n_target")]
    if driver == target:
        return df.agg(*base).select(
            F.when(F.col("n_target") > 0, "ok").otherwise("unsupported").alias("status"), F.lit("direct").alias("basis"),
            F.lit(target).alias("target"), F.lit(driver).alias("driver"), F.lit(pct).alias("pct_change"),
            "base_total", "base_average", (F.col("base_total") * factor).alias("projected_total"),
            (F.col("base_average") * factor).alias("projected_average"), F.lit(pct).alias("delta_pct"),
            F.col("n_target").alias("rows_used"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("string").alias("strength"),
        )
    x = number_of(df, driver)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    fitted = df.agg(
        *base,
        F.try_divide(F.covar_pop(x, y), spread).alias("r"),
        F.regr_slope(y, x).alias("slope"),
        F.avg(F.when(both, x)).alias("driver_mean"),
        F.count(F.when(both, 1)).alias("rows_used"),
    )
    ok = (F.col("rows_used") >= MIN_ROWS) & (F.abs(F.coalesce("r", F.lit(0.0))) >= MIN_R)
    average = F.when(ok, F.col("base_average") + F.col("slope") * F.col("driver_mean") * (factor - 1.0))
    return fitted.withColumn("projected_average", average).select(
        F.when(ok, "ok").otherwise("unsupported").alias("status"), F.lit("relationship").alias("basis"),
        F.lit(target).alias("target"), F.lit(driver).alias("driver"), F.lit(pct).alias("pct_change"),
        "base_total", "base_average", (F.col("projected_average") * F.col("n_target")).alias("projected_total"), "projected_average",
        F.when(F.col("base_average") != 0, 100.0 * (F.col("projected_average") - F.col("base_average")) / F.abs("base_average"))
        .when(ok, 0.0).alias("delta_pct"),
        "rows_used", "r", strength(F.coalesce("r", F.lit(0.0))).alias("strength"),
    )
