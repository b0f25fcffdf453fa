import pytest
import samples
from pyspark.sql import functions as F

from tablescry.operators import profile as pr, routing as ro


def kinds(known):
    return {c["column"]: c["semantic_type"] for c in known.columns}


def test_daily_sales(spark):
    known = pr.profile_table(samples.daily_sales(spark))
    assert kinds(known) == {"order_date": "datetime", "revenue": "numeric", "units": "numeric", "region": "categorical", "channel": "categorical"}
    assert known.has_datetime and not known.has_geo
    roles = ro.route_profile(known)
    assert (roles.archetype, roles.time_col, roles.target_col, roles.entity_col) == ("timeseries", "order_date", "revenue", "region")


def test_sensors(spark):
    known = pr.profile_table(samples.sensors(spark))
    assert kinds(known) == {
        "station_id": "text", "latitude": "geo_lat", "longitude": "geo_lon", "reading_ts": "datetime", "pm25": "numeric",
        "latency": "numeric", "sensor_type": "categorical"}
    roles = ro.route_profile(known)
    assert (roles.archetype, roles.lat_col, roles.lon_col, roles.target_col) == ("geo", "latitude", "longitude", "pm25")


def test_employees(spark):
    known = pr.profile_table(samples.employees(spark))
    assert kinds(known) == {
        "employee_id": "numeric", "department": "categorical", "salary": "numeric", "years_experience": "numeric",
        "satisfaction": "categorical", "notes": "text"}
    roles = ro.route_profile(known)
    assert (roles.archetype, roles.target_col) == ("tabular", "salary")


@pytest.mark.parametrize("rows, distinct, expected", [
    (100, 6, "categorical"), (100, 100, "text"), (100, 21, "text"), (300, 20, "text"), (1000, 20, "categorical")])
def test_category_gate(spark, rows, distinct, expected):
    df = spark.range(rows).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("c"))
    assert kinds(pr.profile_table(df)) == {"c": expected}


def test_out_of_range_coordinates_are_numbers(spark):
    df = spark.range(500).select((F.col("id") * 1.5).alias("lat"), (F.col("id") / 10.0 - 20).alias("lon"))
    assert kinds(pr.profile_table(df)) == {"lat": "numeric", "lon": "geo_lon"}
    assert not pr.profile_table(df).has_geo


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    known = pr.profile_table(df)
    assert known.n_rows == 0 and [c["n_unique"] for c in known.columns] == [0, 0]
    assert pr.profile(df).count() == 2


def test_nested_columns_are_skipped_and_reported(spark):
    df = spark.range(5).select("id", F.array("id").alias("list"))
    known = pr.profile_table(df)
    assert [c["column"] for c in known.columns] == ["id"] and known.facts.skipped == ["list"]


def test_sketch_and_exact_classify_alike_and_partitions_do_not_matter(spark):
    df = samples.employees(spark)
    exact = pr.profile_table(df)
    assert kinds(pr.profile_table(df.repartition(7), "sketch")) == kinds(exact)
    assert {c["column"]: c["n_unique"] for c in exact.columns}["notes"] == 600


def test_numeric_text_category_is_a_measure(spark):
    df = spark.range(400).select((F.col("id") % 5 + 1).cast("string").alias("stars"), (F.col("id") * 1.0).alias("v"))
    known = pr.profile_table(df)
    assert ro.finding_measures(df, known) == ["v", "stars"]
