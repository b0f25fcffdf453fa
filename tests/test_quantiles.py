import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tablescry.operators.quantiles as qt

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = [
        (rnd.gauss(0, 1), 10 ** rnd.uniform(-5, 12), float(rnd.choice([1, 1, 1, 2, 7])), None if i % 3 else float(i),
         1e300 if i == 5 else rnd.random(), None if i % 3 == 0 else f"g{i % 7}")
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, `g.r` string").repartition(6)
    return df.cache(), rows


def expected(values):
    return np.quantile([v for v in values if v is not None], PROBABILITIES)


#: plain; coarse sketches and several narrowing scans; sketches too coarse for the slack, so that brackets miss
SETTINGS = [(4096, 0.003, 512, 2_000_000), (200, 0.03, 64, 40), (8, 0.01, 64, 10), (8, 0.001, 512, 1)]


@pytest.mark.parametrize("sketch, slack, grid, held", SETTINGS)
def test_columns(data, monkeypatch, sketch, slack, grid, held):
    for name, value in (("SKETCH", sketch), ("SLACK", slack), ("GRID", grid), ("HELD_ROWS", held)):
        monkeypatch.setattr(qt, name, value)
    df, rows = data
    table = qt.quantile_table(df, {c: F.col(c) for c in "abcde"}, PROBABILITIES)
    for i, c in enumerate("abcde"):
        np.testing.assert_allclose([table[c][p] for p in PROBABILITIES], expected([r[i] for r in rows]), rtol=1e-12)


@pytest.mark.parametrize("sketch, slack, grid, held", SETTINGS)
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_groups_with_a_large_null_group(data, monkeypatch, sketch, slack, grid, held, broadcast):
    for name, value in (("SKETCH", sketch), ("SLACK", slack), ("GRID", grid), ("HELD_ROWS", held), ("BROADCAST_KEYS", broadcast)):
        monkeypatch.setattr(qt, name, value)
    df, rows = data
    got = {(r["g.r"], r["p"]): r["q"] for r in qt.exact_quantiles(df.select("`g.r`", F.col("b").alias("v")), ["g.r"], PROBABILITIES).collect()}
    for g in {r[5] for r in rows}:
        np.testing.assert_allclose([got[g, p] for p in PROBABILITIES], expected([r[1] for r in rows if r[5] == g]), rtol=1e-12)
    assert len(got) == 7 * 8


def test_few_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert qt.quantile_table(df, {"x": F.col("x")}, [0.5]) == {}
    assert qt.exact_quantiles(df.select(F.col("x").alias("v")).where("v is not null"), [], [0.5]).count() == 0
    for values in ([4.0], [1.0, 2.0], [5.0] * 9, [-0.0, 0.0, 3.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [r["q"] for r in qt.exact_quantiles(df, [], PROBABILITIES).orderBy("p").collect()]
        np.testing.assert_allclose(got, expected(values))
