"""Daily forecasts of any number of series at once, by forests grown level by level.

Every series has two forests: one on its training days, scored on its test days against the
naive baseline, and one on all days, which is projected forward. All forests grow together: a
level is one aggregation of summed targets by (series, forest, tree, node, feature, bin), whose
running sums give the best cut of every node, and one join that moves the days on. Tables of
days times trees are all that is shuffled, so series may be many, and a series is as long as its
calendar. The grown forest of a series is one array of nodes of a fixed size; a test day walks
it with array functions, and the projection folds the last seven days forward the same way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescry.functions.names import NotCalculable, columns_of, resolve_column
from tablescry.operators.forecast import FEATURES, HEAVY_FILL, MIN_ROWS, SEED, chrono_split, daily_series, lag_features
from tablescry.session import cut_lineage

KEYED_TREES, KEYED_DEPTH, BINS = 24, 6, 32
NODE = ["series", "whole", "tree", "node"]


def forecast_by_key(df: DataFrame, time: str, target: str, keys: Sequence[str], horizon: int = 7, trees: int = KEYED_TREES, depth: int = KEYED_DEPTH) -> dict[str, DataFrame]:
    """``metrics`` (a row per series), ``predictions`` (test days) and ``future`` (``horizon`` days) of each series.

    Series with fewer than 30 modelling days have a row of metrics that says so and nothing else. A null
    key is a series. Rows without time or target only count as gaps.
    """
    if horizon < 1:
        raise NotCalculable(f"the horizon must be at least one day, not {horizon}")
    time, target = resolve_column(df, time, "the time axis"), resolve_column(df, target, "the target")
    keys = [resolve_column(df, k, "a key") for k in keys]
    inner = [f"key{i}" for i in range(len(keys))]
    plain = df.select(*(c.alias(n) for c, n in zip(columns_of(keys), inner)), *(c.alias(n) for c, n in zip(columns_of([time, target]), ("at", "value"))))
    daily = daily_series(plain, "at", "value", inner)
    series = cut_lineage(daily.select(F.struct(*inner).alias("series"), "period", "y", "filled").where("y is not null"))
    split = chrono_split(lag_features(series, ["series"]), ["series"])
    counts = series.groupBy("series").agg(F.count("*").alias("n_periods"), F.count_if("filled").alias("n_filled"))
    days = split.join(counts.where(F.col("n_periods") - 7 >= MIN_ROWS), "series").select("series", "period", "y", "is_train", *FEATURES)
    days = cut_lineage(days)
    learned = days.where("is_train").withColumn("whole", F.lit(False)).unionByName(days.withColumn("whole", F.lit(True)))
    forests = _grown(learned, trees, depth)

    predicted = days.where("not is_train").join(forests.where("not whole"), "series")
    predicted = predicted.withColumn("predicted", _prediction(F.col("forest"), [F.col(c).cast("double") for c in FEATURES], trees, depth))
    predicted = cut_lineage(predicted.select("series", "period", F.col("y").alias("actual"), "predicted", "lag_1"))
    scored = predicted.groupBy("series").agg(
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("test_mae"), F.avg(F.abs(F.col("actual") - F.col("lag_1"))).alias("baseline_mae"), F.count("*").alias("n_test"))
    share = F.col("n_filled") / F.col("n_periods") > HEAVY_FILL
    gain = 100.0 * (F.col("baseline_mae") - F.col("test_mae")) / F.col("baseline_mae")
    metrics = counts.join(scored, "series", "left").select(
        "series", F.when(F.col("n_test").isNull(), "insufficient_data").otherwise("ok").alias("status"), "test_mae", "baseline_mae",
        (F.col("test_mae") < F.col("baseline_mae")).alias("beats_baseline"), F.when(F.col("baseline_mae") > 0, gain).otherwise(F.when(F.col("n_test") > 0, 0.0)).alias("improvement_pct"),
        F.coalesce(F.col("n_periods") - 7 - F.col("n_test"), F.lit(0).cast("long")).alias("n_train"), F.coalesce("n_test", F.lit(0).cast("long")).alias("n_test"),
        "n_periods", "n_filled", share.alias("heavily_filled"),
    )
    last = series.withColumn("back", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("period")))).where("back <= 7")
    last = last.groupBy("series").agg(F.max("period").alias("last"), F.array_sort(F.collect_list(F.struct("period", "y"))).alias("week"))
    future = last.join(forests.where("whole"), "series").select("series", F.posexplode(_projection(horizon, trees, depth)).alias("at", "predicted"), "last")
    future = future.select("series", (F.col("at") + 1).alias("step"), F.date_add("last", F.col("at") + 1).alias("period"), "predicted")

    def named(frame: DataFrame) -> DataFrame:
        return frame.select(*(F.col(f"series.{n}") for n in inner), *(c for c in frame.columns if c != "series")).toDF(*keys, *(c for c in frame.columns if c != "series"))

    return {"metrics": named(metrics), "predictions": named(predicted.drop("lag_1")), "future": named(future)}


def _copies(tree: Column, period: Column) -> Column:
    """How often a tree takes a day: a Poisson number of mean 1 from a hash, so that every run takes the same."""
    chance = F.pmod(F.xxhash64(F.lit(SEED), tree, period), F.lit(1 << 30)) / float(1 << 30)
    sums, term, total = [], math.exp(-1), 0.0
    for k in range(1, 7):
        total += term
        sums.append(total)
        term /= k
    return sum(((chance >= s).cast("int") for s in sums[1:]), (chance >= sums[0]).cast("int"))


def _grown(days: DataFrame, trees: int, depth: int) -> DataFrame:
    """(series, whole, forest): the forest as an array of (feature, cut, value), node n of tree t at t * 2^(depth+1) + n."""
    binned = days.withColumns({
        f"bin_{c}": F.floor((F.rank().over(Window.partitionBy("series", "whole").orderBy(c)) - 1) * BINS / F.count("*").over(Window.partitionBy("series", "whole"))).cast("int")
        for c in FEATURES})
    bins = F.array(*(F.col(f"bin_{c}") for c in FEATURES))
    cuts = [F.struct(F.lit(i).alias("feature"), F.col(f"bin_{c}").alias("bin"), F.col(c).cast("double").alias("cut")) for i, c in enumerate(FEATURES)]
    binned = cut_lineage(binned)
    edges = binned.select("series", "whole", F.explode(F.array(*cuts)).alias("e")).groupBy("series", "whole", "e.feature", "e.bin").agg(F.max("e.cut").alias("cut"))
    rows = binned.select("series", "whole", "period", "y", bins.alias("bins"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.withColumn("w", _copies(F.col("tree"), F.col("period"))).where("w > 0").withColumn("node", F.lit(1))
    splits = []
    for level in range(depth):
        rows = cut_lineage(rows)
        here = rows.where(F.col("node") >= 2**level).select(*NODE, "w", "y", F.posexplode("bins").alias("feature", "bin"))
        sums = here.groupBy(*NODE, "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
        along = Window.partitionBy(*NODE, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy(*NODE, "feature")
        cut = sums.select(*NODE, "feature", "bin", *(F.sum(c).over(w).alias(n) for c, w, n in (("n", along, "nl"), ("s", along, "sl"), ("n", every, "na"), ("s", every, "sa")))).where("nl < na")
        gain = F.col("sl") ** 2 / F.col("nl") + (F.col("sa") - F.col("sl")) ** 2 / (F.col("na") - F.col("nl")) - F.col("sa") ** 2 / F.col("na")
        best = cut.withColumn("gain", gain).where(F.col("gain") > 1e-9 * F.col("sa") ** 2 / F.col("na") + 1e-12)
        best = best.groupBy(*NODE).agg(F.max_by(F.struct("feature", "bin"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("split"))
        best = cut_lineage(best)
        splits.append(best)
        moved = rows.join(best, NODE, "left")
        rows = moved.withColumn("node", F.when(F.col("split").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.get("bins", F.col("split.feature")) > F.col("split.bin")).cast("int"))).drop("split")
    leaves = rows.groupBy(*NODE).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))
    inner = reduce(DataFrame.unionByName, splits).select(*NODE, "split.feature", "split.bin").join(edges, ["series", "whole", "feature", "bin"])
    nodes = inner.select(*NODE, "feature", "cut", F.lit(None).cast("double").alias("value")).unionByName(
        leaves.select(*NODE, F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("cut"), "value"))
    size = 2 ** (depth + 1)
    places = binned.select("series", "whole").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(trees * size - 1))))
    placed = nodes.withColumn("place", F.col("tree") * size + F.col("node")).drop("tree", "node")
    filled = places.join(placed, ["series", "whole", "place"], "left").groupBy("series", "whole")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.struct("feature", "cut", "value").alias("at"))))  # trees * size entries
    return cut_lineage(filled.agg(F.transform(ordered, lambda x: x["at"]).alias("forest")))


def _prediction(forest: Column, point: list[Column], trees: int, depth: int) -> Column:
    """The mean of the leaves that a point reaches; a tree without days in it has no say."""
    size, features = 2 ** (depth + 1), F.array(*point)

    def leaf(tree: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            at = F.get(forest, tree * size + node)
            return F.when(at["feature"].isNull(), node).otherwise(2 * node + (F.get(features, at["feature"]) > at["cut"]).cast("int"))

        return F.get(forest, tree * size + F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down))["value"]

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), leaf), lambda v: v.isNotNull())
    return F.aggregate(found, F.lit(0.0), lambda a, v: a + v) / F.size(found)


def _projection(horizon: int, trees: int, depth: int) -> Column:
    """Predictions of the days after ``last``, each fed into the next; needs only the seven days of ``week``."""
    start = F.transform("week", lambda d: d["y"])

    def further(days: Column, step: Column) -> Column:
        week = F.slice(days, -7, 7)
        day = F.date_add(F.col("last"), step)
        mean = F.aggregate(week, F.lit(0.0), lambda a, v: a + v) / 7
        point = [F.get(week, F.lit(6)), F.get(week, F.lit(0)), mean, F.weekday(day).cast("double"), F.month(day).cast("double")]
        return F.concat(days, F.array(_prediction(F.col("forest"), point, trees, depth)))

    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, further), 8, horizon)
