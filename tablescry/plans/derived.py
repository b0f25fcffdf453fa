"""Tables with faults, coordinates and decorated text, derived from the given ones.

The given tables hold no gaps, no spelling variants and no coordinates. These
views add them row by row from the keys, in place, over the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.session import own_folder


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one; a local session without any gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tablescry-{uuid.uuid4().hex}"
    return own_folder(spark, "tablescry-")


def messy_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Every quality fault at once, on the customer table; each 50th row appears twice."""
    c = load(spark, folder, "customer")
    key = F.col("c_custkey")
    city = F.concat(F.lit("Port "), F.element_at(F.array(*map(F.lit, ["Alba", "Bree", "Corr", "Dunn", "Esk"])), (F.col("c_nationkey") % 5 + 1).cast("int")))
    spelled = (
        F.when(key % 7 == 0, F.lower(city)).when(key % 11 == 0, F.upper(city)).when(key % 13 == 0, F.concat(city, F.lit(" "))).otherwise(city)
    )
    messy = c.select(
        key.alias("customer_ref"),
        spelled.alias("city"),
        F.concat(F.lit("Rs "), F.format_number("c_acctbal", 2)).alias("spend"),
        F.when(key % 97 == 0, -5.0).when(key % 101 == 0, 250.0).otherwise((20 + key % 60).cast("double")).alias("age"),
        F.when(key % 5 == 0, F.lit(None).cast("string"))
        .when(key % 17 == 0, "N/A")
        .when(key % 19 == 0, " unknown ")
        .otherwise(F.col("c_mktsegment")).alias("segment"),
        F.lit(None).cast("string").alias("notes"),
        F.lit("R1").alias("region_code"),
        F.when(key % 400 == 1, F.col("c_acctbal") * 1000).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(key % 400 == 1, F.col("c_acctbal") * 1000).otherwise(F.col("c_acctbal")).alias("balance_again"),
        F.when(key % 4 == 0, key.cast("string")).otherwise(F.col("c_name")).alias("label"),
        F.when(key % 10 != 3, F.col("c_acctbal")).alias("gappy"),
    )
    return messy.unionByName(messy.where(F.col("customer_ref") % 50 == 0))


MESSY_SQL = """
messy_once AS (
  SELECT c_custkey AS customer_ref,
    CASE WHEN c_custkey % 7 = 0 THEN lower(city) WHEN c_custkey % 11 = 0 THEN upper(city)
         WHEN c_custkey % 13 = 0 THEN city || ' ' ELSE city END AS city,
    'Rs ' || format('{:,.2f}', c_acctbal) AS spend,
    CASE WHEN c_custkey % 97 = 0 THEN -5.0::DOUBLE WHEN c_custkey % 101 = 0 THEN 250.0::DOUBLE
         ELSE (20 + c_custkey % 60)::DOUBLE END AS age,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'N/A'
         WHEN c_custkey % 19 = 0 THEN ' unknown ' ELSE c_mktsegment END AS segment,
    NULL::VARCHAR AS notes, 'R1' AS region_code,
    CASE WHEN c_custkey % 400 = 1 THEN c_acctbal * 1000 ELSE c_acctbal END AS balance,
    CASE WHEN c_custkey % 400 = 1 THEN c_acctbal * 1000 ELSE c_acctbal END AS balance_again,
    CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS label,
    CASE WHEN c_custkey % 10 != 3 THEN c_acctbal END AS gappy
  FROM (SELECT *, 'Port ' || ['Alba','Bree','Corr','Dunn','Esk'][(c_nationkey % 5 + 1)::INT] AS city FROM customer)),
messy AS (SELECT * FROM messy_once UNION ALL SELECT * FROM messy_once WHERE customer_ref % 50 = 0)
"""


def placed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with coordinates derived from their keys; every 50th has none."""
    key = F.col("c_custkey")
    return load(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 50 != 0, 50.0 + (key * 37 % 850) / 100.0).alias("latitude"),
        (-6.0 + (key * 91 % 770) / 100.0).alias("longitude"),
        F.col("c_acctbal").alias("reading"),
        F.col("c_mktsegment").alias("sensor_type"),
    )


PLACED_SQL = """
placed AS (
  SELECT c_custkey, CASE WHEN c_custkey % 50 != 0 THEN 50.0::DOUBLE + (c_custkey * 37 % 850) / 100.0::DOUBLE END AS latitude,
    -6.0::DOUBLE + (c_custkey * 91 % 770) / 100.0::DOUBLE AS longitude, c_acctbal AS reading, c_mktsegment AS sensor_type
  FROM customer),
ok AS (SELECT * FROM placed WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND reading IS NOT NULL)
"""


def written_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in six layouts, and some that are no dates."""
    o = load(spark, folder, "orders")
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(key % 8 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(key % 8 == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(key % 8 == 2, F.date_format(d, "MM/dd/yyyy"))
        .when(key % 8 == 3, F.date_format(d, "yyyy/MM/dd"))
        .when(key % 8 == 4, F.date_format(d, "d MMM yyyy"))
        .when(key % 8 == 5, F.date_format(d, "MMMM d, yyyy"))
        .when(key % 8 == 6, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("N/A"))
    )
    return o.select("o_orderkey", text.alias("written"), "o_totalprice")


WRITTEN_SQL = """
written AS (
  SELECT o_orderkey, o_totalprice, o_orderdate AS d, CASE o_orderkey % 8
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
    WHEN 4 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 5 THEN strftime(o_orderdate, '%B %-d, %Y')
    WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'N/A' END AS written
  FROM orders),
read AS (
  SELECT o_orderkey, o_totalprice, written, CASE
    WHEN o_orderkey % 8 = 7 THEN NULL
    WHEN o_orderkey % 8 = 1 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d))
    ELSE d::DATE END AS day
  FROM written)
"""


def sparse_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with whole days missing and gaps in the value, for fills and calendars."""
    e = load(spark, folder, "events")
    day = F.dayofmonth("ts")
    return e.select(
        "event_id", "ts", "user_id", "event_type",
        F.when((day % 7 != 3) & (F.col("event_id") % 9 != 2) & (F.col("event_id") > 4), F.col("value")).alias("value"),
    )


SPARSE_SQL = """
sparse AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN day(ts) % 7 != 3 AND event_id % 9 != 2 AND event_id > 4 THEN value END AS value FROM events)
"""


def story_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with something to find: growth, a linked measure, spikes, a leading
    channel, gaps, and each 80th row written twice."""
    o = load(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    years = F.year("o_orderdate") - 1995
    lead = F.when(F.col("o_orderstatus") == "F", 1.5).otherwise(1.0)
    revenue = F.when(key % 500 == 7, price * 60).otherwise(price * (1 + years * 0.1) * lead)
    story = o.select(
        F.col("o_orderdate").alias("order_date"),
        revenue.alias("revenue"),
        (revenue * 0.4 + (key * 17 % 1000) * 30).alias("cost"),
        F.when(key % 4 != 1, (key * 13 % 997).cast("double")).alias("stock_level"),
        F.col("o_orderstatus").alias("channel"),
        F.col("o_orderpriority").alias("grade"),
    )
    return story.unionByName(story.where(F.col("stock_level") % 80 == 0))


STORY_SQL = """
story_once AS (
  SELECT o_orderdate AS order_date, revenue, revenue * 0.4::DOUBLE + (o_orderkey * 17 % 1000) * 30 AS cost,
    CASE WHEN o_orderkey % 4 != 1 THEN (o_orderkey * 13 % 997)::DOUBLE END AS stock_level, o_orderstatus AS channel, o_orderpriority AS grade
  FROM (SELECT *, CASE WHEN o_orderkey % 500 = 7 THEN o_totalprice * 60
      ELSE o_totalprice * (1 + (year(o_orderdate) - 1995) * 0.1::DOUBLE) * CASE WHEN o_orderstatus = 'F' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END END AS revenue FROM orders)),
story AS (SELECT * FROM story_once UNION ALL SELECT * FROM story_once WHERE stock_level % 80 = 0)
"""
