"""Daily forecasts that are scored against a naive baseline.

Raw rows are reduced to one row per day first; everything after that works on
as many rows as the calendar has days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescry.functions.names import NotCalculable, columns_of, resolve_column
from tablescry.operators.timeseries import resample
from tablescry.session import cut_lineage

FEATURES = ["lag_1", "lag_7", "rolling_mean_7", "day_of_week", "month"]
MIN_ROWS = 30
TRAIN_SHARE = 0.8
HEAVY_FILL = 0.30
TREES, SEED, DEPTH = 100, 42, 8


def _order(keys: Sequence[str]):
    return Window.partitionBy(*(columns_of(keys) or [F.lit(1)])).orderBy("period")


def daily_series(df: DataFrame, time: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, period, y, filled): daily means, gaps carried forward from the day before."""
    days = resample(df, time, target, "D", "mean", keys)
    known = F.last("value", ignorenulls=True).over(_order(keys).rowsBetween(Window.unboundedPreceding, 0))
    return days.select(*keys, "period", known.alias("y"), F.col("value").isNull().alias("filled"))


def lag_features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Yesterday, a week ago, the mean of the seven days before, weekday and month.

    The window ends the day before, so a row never sees its own value. The
    first seven days lack a full history and are dropped.
    """
    order = _order(keys)
    return (
        series.withColumns({
            "lag_1": F.lag("y", 1).over(order),
            "lag_7": F.lag("y", 7).over(order),
            "rolling_mean_7": F.avg("y").over(order.rowsBetween(-7, -1)),
            "day_of_week": F.weekday("period"),
            "month": F.month("period"),
        })
        .where("lag_7 is not null")
    )


def chrono_split(features: DataFrame, keys: Sequence[str] = (), train_share: float = TRAIN_SHARE) -> DataFrame:
    """Flag the first 80 % of the days, in time order, as training days."""
    part = Window.partitionBy(*(columns_of(keys) or [F.lit(1)]))
    n = F.count("*").over(part)
    return features.withColumn("is_train", F.row_number().over(_order(keys)) <= F.floor(n * F.lit(train_share)))


def naive_baseline(split: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Error of predicting yesterday's value over the test days."""
    return split.groupBy(*columns_of(keys)).agg(
        F.avg(F.when(~F.col("is_train"), F.abs(F.col("y") - F.col("lag_1")))).alias("baseline_mae"),
        F.count_if(F.col("is_train")).alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_test"),
    )


def _forest(rows: DataFrame) -> RandomForestRegressionModel:
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="y", numTrees=TREES, seed=SEED, maxDepth=DEPTH, featureSubsetStrategy="all",
        maxMemoryInMB=1024,
    )
    return forest.fit(rows)


def forecast(df: DataFrame, time: str, target: str, horizon: int = 7, project: bool = True) -> dict[str, Any]:
    """Fit, score against the baseline, and project ``horizon`` days forward.

    Returns ``status`` and DataFrames ``metrics`` (one row), ``predictions``
    (test days), ``future`` and ``importances``; only ``status`` and ``metrics``
    for a series with fewer than 30 modelling days. Without ``project`` no second
    forest is fitted on all days and there is no ``future``.
    """
    if horizon < 1:
        raise NotCalculable(f"the horizon must be at least one day, not {horizon}")
    time, target = resolve_column(df, time, "the time axis"), resolve_column(df, target, "the target")
    spark = df.sparkSession
    series = cut_lineage(daily_series(df, time, target))
    counts = series.agg(F.count("*").alias("n"), F.count_if(F.col("filled")).alias("filled")).first()
    n_rows = max(0, counts["n"] - 7)
    share = counts["filled"] / counts["n"] if counts["n"] else 0.0
    if n_rows < MIN_ROWS:
        row = ("insufficient_data", None, None, None, None, 0, 0, counts["n"], counts["filled"], share > HEAVY_FILL)
        return {"status": "insufficient_data", "metrics": spark.createDataFrame([row], _METRICS)}

    split = chrono_split(lag_features(series))
    rows = cut_lineage(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(split))
    train = rows.where("is_train").repartition(_model_partitions(spark, n_rows))
    model = _forest(train)
    predictions = model.transform(rows.where("not is_train")).select("period", F.col("y").alias("actual"), F.col("prediction").alias("predicted"), "lag_1")
    scored = predictions.agg(
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("model"), F.avg(F.abs(F.col("actual") - F.col("lag_1"))).alias("naive"),
        F.count("*").alias("n_test"),
    ).first()
    gain = 100.0 * (scored["naive"] - scored["model"]) / scored["naive"] if scored["naive"] > 0 else 0.0
    metrics = spark.createDataFrame(
        [("ok", scored["model"], scored["naive"], scored["model"] < scored["naive"], gain, n_rows - scored["n_test"],
          scored["n_test"], counts["n"], counts["filled"], share > HEAVY_FILL)],
        _METRICS,
    )
    weights = spark.createDataFrame(
        [(name, float(w)) for name, w in zip(FEATURES, model.featureImportances.toArray())], "feature string, importance double"
    )
    found = {"status": "ok", "metrics": metrics, "predictions": predictions.drop("lag_1"), "importances": weights}
    if project:
        found["future"] = recursive_projection(_forest(rows.repartition(_model_partitions(spark, n_rows))), series, horizon)
    return found


_METRICS = (
    "status string, test_mae double, baseline_mae double, beats_baseline boolean, improvement_pct double, n_train long, "
    "n_test long, n_periods long, n_filled long, heavily_filled boolean"
)


def _model_partitions(spark, n_rows: int) -> int:
    """Days are few; a task per ten thousand of them is plenty."""
    return max(1, n_rows // 10_000)


def recursive_projection(model: RandomForestRegressionModel, series: DataFrame, horizon: int) -> DataFrame:
    """Feed each predicted day into the next. Needs only the last seven days."""
    last = series.orderBy(F.desc("period")).limit(7).select("period", "y").collect()
    history = [row["y"] for row in reversed(last)]
    day = last[0]["period"]
    rows = []
    for step in range(1, horizon + 1):
        day = day + timedelta(days=1)
        week = history[-7:]
        point = Vectors.dense([history[-1], week[0], sum(week) / len(week), day.weekday(), day.month])
        value = float(model.predict(point))
        history.append(value)
        rows.append((step, day, value))
    return series.sparkSession.createDataFrame(rows, "step int, period date, predicted double")
