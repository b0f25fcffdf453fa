import random

import pytest
import samples
from pyspark.sql import functions as F

from tablescry.functions.names import NotCalculable
from tablescry.operators import (
    aggregates as ag, anomalies as an, chartdata as ch, comparison as cp, correlation as co, findings as fi, geo as ge, whatif as wi,
)
from tablescry.operators.profile import profile_table
from tablescry.operators.routing import Routing
from tablescry.plans import analyse as al
from tablescry.plans.registered import QUERIES


def test_ranking_ties_and_limits(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0), (None, 9.0), ("d", None)], "g string, v double")
    assert [r["group"] for r in ag.rank_groups(df, "g", "v", "total").collect()] == ["c", "a", "b"]
    assert ag.rank_groups(df, "G", "V", "count", 1).first()["n_groups"] == 4
    assert [r["group"] for r in ag.rank_groups(df, "g", "v", "mean", 1, "worst").collect()] == ["a"]
    assert ag.rank_groups(df, "g", "v", n=10_000).count() <= 25


def test_pairwise_correlation(spark):
    rows = [(float(i), 2.0 * i if i % 2 else None, 5.0, float(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, constant double, d double")
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in co.correlation_pairs(df, ["a", "b", "constant", "d"]).collect()}
    assert got["a", "b"] == (pytest.approx(1.0), 20) and got["a", "d"] == (pytest.approx(-1.0), 40)
    assert got["a", "constant"][0] is None
    assert {(r["a"], r["b"]) for r in co.correlation_matrix(df, ["a", "constant"]).collect()} == {("a", "a")}
    assert [r["r"] for r in co.correlation_pairs(df.limit(0), ["a", "b"]).collect()] in ([], [None])
    assert co.relationship(df.limit(5), "a", "d").count() == 0
    with pytest.raises(NotCalculable):
        co.relationship(df, "a", "a")


def test_best_pair_ignores_one_measure_under_two_names(spark):
    rnd = random.Random(1)
    rows = [(float(i), i * 3.0, i + rnd.gauss(0, 9), rnd.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, copy double, near double, noise double")
    row = co.best_pair(df, ["a", "copy", "near", "noise"]).first()
    assert {row["a"], row["b"]} & {"near"} and abs(row["r"]) <= 0.995


def test_extreme_row_is_named(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(100, 5)) for i in range(40)] + [(99, 987654.321)]
    df = spark.createDataFrame(rows, "id long, v double")
    row = an.anomalies(df, ["v"], ["id"]).first()
    assert (row["n_unusual"], row["row_key"], row["value"]) == (1, "99", 987654.321)
    far = an.outlier_rows(df, "v", ["id"], 3).orderBy(F.desc(F.abs("difference"))).first()
    assert far["id"] == 99 and far["n_unusual"] == 1 and far["usual_low"] < far["typical"] < far["usual_high"]
    assert an.outlier_rows(df.limit(5), "v", ["id"]).count() == 0
    assert an.anomalies(df.where("v < 1000"), ["v"], ["id"]).count() == 0


def test_findings_of_sales(spark):
    found = {(r["kind"], r["subject"]): r["direction"] for r in fi.findings(samples.daily_sales(spark)).collect()}
    assert found["trend", "revenue"] == "up" and found["forecast", "revenue"] == "ready"
    scores = [r["score"] for r in fi.findings(samples.daily_sales(spark)).collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) <= 12


def test_briefing_leads_with_serious_issues(spark):
    points = al.analyse(samples.messy(spark)).briefing.collect()
    assert [p["kind"] for p in points[:2]] == ["issue", "issue"] and len(points) <= 5
    calm = al.analyse(samples.employees(spark).drop("notes")).briefing.collect()
    assert {"quality", "shape"} <= {p["kind"] for p in calm}


def test_compare_pair(spark):
    rnd = random.Random(5)
    before = spark.createDataFrame([(rnd.uniform(50, 150), "web" if i % 2 else "shop") for i in range(120)], "revenue double, channel string")
    after = before.limit(90).select((F.col("revenue") * 1.4).alias("Revenue"), "channel", F.lit(0.1).alias("discount"))
    changes = {r["kind"]: r for r in cp.compare(before, after).collect()}
    assert changes["row_count"]["direction"] == "down" and changes["columns_added"]["after"] == 1.0
    assert changes["measure"]["column"] == "revenue" and changes["measure"]["before"] < 200
    same = cp.compare(before, before)
    assert same.count() == 0


def test_registered_compare_reports_quality(spark, tmp_path):
    day = F.when(F.col("id") < 60, F.lit("1997-06-01")).otherwise(F.lit("1998-06-01")).cast("timestamp_ntz")
    orders = spark.range(120).select(
        F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.col("id") % 10 + 95.5).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.unionByName(orders.where("o_orderkey >= 60")).write.parquet(str(tmp_path / "orders.parquet"))
    rows = [r for r in QUERIES["compare"](spark, str(tmp_path)).collect() if r["kind"] == "quality"]
    assert len(rows) == 1 and rows[0]["direction"] == "down" and rows[0]["before"] - rows[0]["after"] >= 3


def test_unrelated_tables_do_not_compare(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, "a")], "totally int, different string")
    assert not cp.comparable(a, b).first()["comparable"] and cp.compare(a, b).count() == 0


def test_spread_alone_is_reported_unless_strict(spark):
    a = spark.range(100).select((F.col("id") % 10 + 95.5).alias("v"))
    b = spark.range(100).select(((F.col("id") % 10 - 4.5) * 3 + 100).alias("v"))
    assert [r["kind"] for r in cp.measure_changes(a, b, {"v": "v"}, 100, 100).collect()] == ["spread"]
    assert cp.measure_changes(a, b, {"v": "v"}, 100, 100, strict=True).count() == 0


def test_simulation(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(float(i), 3.0 * i + 7, rnd.random()) for i in range(100)], "x double, y double, noise double")
    direct = wi.simulate(df, "y", 1000).first()
    assert direct["pct_change"] == 200.0 and direct["projected_total"] == pytest.approx(3 * direct["base_total"])
    through = wi.simulate(df, "y", 10, "x").first()
    assert through["status"] == "ok" and through["projected_average"] - through["base_average"] == pytest.approx(3 * 49.5 * 0.1)
    weak = wi.simulate(df, "y", 10, "noise").first()
    assert weak["status"] == "unsupported" and weak["projected_total"] is None
    assert [r["driver"] for r in wi.drivers(df, "y").where("suggested").collect()] == ["x"]


def test_points_in_one_spot(spark):
    df = spark.range(20).select(F.lit(51.5).alias("lat"), F.lit(-0.1).alias("lon"), F.lit(3.0).alias("pm25"))
    assert ge.map_view(df, "lat", "lon", "pm25").first()["zoom"] == 10.0
    assert {r["marker_size"] for r in ge.map_points(df, "lat", "lon", "pm25").collect()} == {15.5}
    assert ge.densest_cell(df, "lat", "lon", "pm25").first()["n_points"] == 20
    assert ge.densest_cell(df.limit(1), "lat", "lon", "pm25").count() == 0


def test_worlds_decline_instead_of_failing(spark):
    words = spark.createDataFrame([("a b c",)] * 30, "note string")
    assert al.world(words).status == "insufficient_data"
    assert al.timeseries_bundle(words, Routing("timeseries", "when", None, "v")).status == "insufficient_data"
    assert al.geo_bundle(words, Routing("geo")).status == "insufficient_data"
    assert ch.chart_candidates(words).count() == 0
    assert set(al.world(samples.sensors(spark)).tables) == {"points", "view", "densest_cell", "stats"}
    assert {"series", "stats", "trend", "by_entity"} == set(al.world(samples.daily_sales(spark)).tables)


def test_leading_chart_by_shape(spark):
    def kinds(df):
        return [r["kind"] for r in ch.chart_candidates(df).collect()]

    assert kinds(samples.daily_sales(spark))[0] == "trend"
    geo = kinds(samples.sensors(spark))
    assert geo[0] == "trend" and "map" in geo
    assert kinds(samples.employees(spark))[0] == "ranking"


def test_constant_histogram_and_box(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), F.lit(4.0).alias("v"))
    assert [(r["bin"], r["n"]) for r in ch.histogram(df, "v").collect()] == [(0, 10)]
    box = ch.box_stats(df, "g", "v").first()
    assert (box["q25"], box["whisker_low"], box["n_outliers"]) == (4.0, 4.0, 0)
    ten = ch.histogram(spark.range(31).select(F.col("id").cast("double").alias("v")), "v").collect()
    assert sum(r["n"] for r in ten) == 31 and max(r["bin"] for r in ten) == 29


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    pick = sorted(r["id"] for r in ag.row_sample(df, 50, ["id"]).collect())
    assert pick == sorted(r["id"] for r in ag.row_sample(df.repartition(9), 50, ["id"]).collect()) and len(pick) == 50


def test_time_range_is_checked(spark):
    with pytest.raises(NotCalculable):
        ag.in_time_range(samples.daily_sales(spark), "order_date", "2024-02-01", "2024-01-01")


def test_known_profile_is_reused(spark):
    df = samples.employees(spark)
    known = profile_table(df)
    assert {r["label"] for r in ag.kpis(df, known).collect()} >= {"Rows", "Columns", "Average"}
    assert "salary" in {r["column"] for r in ag.kpis(df, known).collect()}
