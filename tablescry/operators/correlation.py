"""Pairwise-complete correlation, straight-line fits and the pairs worth a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescry.functions.names import NotCalculable, resolve_column
from tablescry.operators.aggregates import number_of

STRONG, CLEAR, WEAK = 0.75, 0.5, 0.3


def strength(r: Column) -> Column:
    return (
        F.when(F.abs(r) >= STRONG, "very close")
        .when(F.abs(r) >= CLEAR, "clear")
        .when(F.abs(r) >= WEAK, "weak")
        .otherwise("none")
    )


def _moments(width: int, centres: list[float]):
    """Per-batch matrix products that hold every pair's sums at once.

    For centred values X (missing as 0) and presence M: X'X, X'M, (X*X)'M and
    M'M give each pair its cross product, sums, squares and overlap over the
    rows that have both.
    """

    def products(batches):
        import numpy as np
        import pyarrow as pa

        centre, total = np.array(centres), np.zeros((4, width, width))
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns])
            present = ~np.isnan(x)
            x, m = np.where(present, x - centre, 0.0), present.astype(float)
            total += np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel().tolist()]}, schema=pa.schema([("sums", pa.list_(pa.float64()))]))

    return products


def correlation_pairs(df: DataFrame, columns: list[str], min_overlap: int = 1) -> DataFrame:
    """(a, b, r, n) for every pair of columns; r is null for a constant.

    One pass for the means, one for all pairs together: each task reduces its
    rows to four small matrices, and only those are shuffled. Centring on the
    means keeps the sums from cancelling.
    """
    width = len(columns)
    spark = df.sparkSession
    if width < 2:
        return spark.createDataFrame([], "a string, b string, r double, n long")
    values = df.select(*[number_of(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    centres = [float(m or 0.0) for m in values.agg(*[F.avg(c) for c in values.columns]).first()]
    pieces = values.mapInArrow(_moments(width, centres), "sums array<double>")
    cells = pieces.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    part, i, j = F.floor(F.col("at") / width**2), F.floor(F.col("at") / width) % width, F.col("at") % width

    def pick(which: int, first: Column, second: Column) -> Column:
        return F.max(F.when((F.col("part") == which) & (first < second), F.col("s")))

    i_first, j_first = (F.col("i"), F.col("j")), (F.col("j"), F.col("i"))
    sums = (
        cells.select(part.alias("part"), i.alias("i"), j.alias("j"), "s").where("i != j")
        .groupBy(F.least("i", "j").alias("left"), F.greatest("i", "j").alias("right"))
        .agg(
            pick(0, *i_first).alias("xy"), pick(1, *i_first).alias("x"), pick(1, *j_first).alias("y"),
            pick(2, *i_first).alias("xx"), pick(2, *j_first).alias("yy"), pick(3, *i_first).cast("long").alias("n"),
        )
    )
    names, means = F.array(*map(F.lit, columns)), F.array(*map(F.lit, centres))

    def spread(square: str, total: str, place: str) -> Column:
        """Variance, or null when it is only rounding noise around one value."""
        variance = F.try_divide(F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n")), F.col("n"))
        noise = F.pow(F.abs(F.get(means, F.col(place).cast("int"))) * 1e-13, 2)
        return F.when(variance > noise, variance)

    covariance = F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n")), F.col("n"))
    r = F.nullif(F.try_divide(covariance, F.sqrt(spread("xx", "x", "left") * spread("yy", "y", "right"))), F.lit(float("nan")))
    return sums.select(
        F.get(names, F.col("left").cast("int")).alias("a"),
        F.get(names, F.col("right").cast("int")).alias("b"),
        # least and greatest skip nulls, so an undefined r must not reach them
        F.when((F.col("n") >= min_overlap) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
        "n",
    )


def correlation_matrix(df: DataFrame, columns: list[str], min_overlap: int = 1) -> DataFrame:
    """The full square grid as (a, b, r, n); columns that never vary are left out."""
    pairs = correlation_pairs(df, columns, min_overlap).where("r is not null")
    mirrored = pairs.select(F.explode(F.array(
        F.struct(F.col("a"), F.col("b"), F.col("r"), F.col("n")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r"), F.col("n")),
    )).alias("p")).select("p.*")
    own = df.agg(*[
        F.struct(
            F.lit(c).alias("a"), F.lit(c).alias("b"),
            F.when(F.stddev_pop(number_of(df, c)) > 0, 1.0).alias("r"), F.count(number_of(df, c)).alias("n"),
        ).alias(f"d{i}")
        for i, c in enumerate(columns)
    ]).select(F.explode(F.array(*[F.col(f"d{i}") for i in range(len(columns))])).alias("p")).select("p.*")
    return mirrored.unionByName(own.where("r is not null"))


def relationship(df: DataFrame, a: str, b: str, min_rows: int = 10) -> DataFrame:
    """How closely two columns move together."""
    a, b = resolve_column(df, a, "the first column"), resolve_column(df, b, "the second column")
    if a == b:
        raise NotCalculable("those are the same column")
    return (
        correlation_pairs(df, [a, b])
        .where(F.col("n") >= min_rows)
        .select(
            "a", "b", "r", "n",
            F.when(F.col("r") > 0, "same direction").otherwise("opposite directions").alias("direction"),
            strength(F.coalesce("r", F.lit(0.0))).alias("strength"),
        )
    )


def relationships(df: DataFrame, measures: list[str], k: int | None = 3, min_r: float = CLEAR, min_overlap: int = 20) -> DataFrame:
    """Pairs at or above ``min_r``, strongest first, with how many there are in all."""
    found = correlation_pairs(df, measures, min_overlap).where(F.abs("r") >= min_r)
    listed = found.select("a", "b", "r", "n", strength(F.col("r")).alias("strength"),
                          F.count("*").over(Window.partitionBy(F.lit(1))).alias("n_pairs"))
    return listed.orderBy(F.desc(F.abs("r")), "a", "b").limit(k) if k else listed


def best_pair(df: DataFrame, measures: list[str], min_rows: int = 10, too_close: float = 0.995) -> DataFrame:
    """The most correlated pair that is not one measure under two names (0 or 1 row)."""
    return (
        correlation_pairs(df, measures, min_rows)
        .where((F.col("r").isNotNull()) & (F.abs("r") <= too_close))
        .orderBy(F.desc(F.abs("r")), "a", "b")
        .limit(1)
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over rows with both values; null when x never varies."""
    vx, vy = number_of(df, x), number_of(df, y)
    both = vx.isNotNull() & vy.isNotNull()
    return df.agg(
        F.regr_slope(vy, vx).alias("slope"),
        F.regr_intercept(vy, vx).alias("intercept"),
        F.count(F.when(both, 1)).alias("n"),
        F.min(F.when(both, vx)).alias("x_min"),
        F.max(F.when(both, vx)).alias("x_max"),
    )
