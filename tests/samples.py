"""Small tables with known faults and shapes, seeded and written for these tests."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession


def daily_sales(spark: SparkSession) -> DataFrame:
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        day = datetime(2023, 1, 1) + timedelta(days=i)
        text = day.strftime("%d/%m/%Y") if i % 3 == 0 else day.strftime("%Y-%m-%d")
        if i in (10, 50, 123):
            text = "N/A"
        revenue = 100 + 160 * i / 399 + 25 * math.sin(i * 2 * math.pi / 7) + rnd.gauss(0, 12)
        rows.append((text, revenue, rnd.randint(1, 39), rnd.choice(["North", "South", "East", "West"]), rnd.choice(["online", "retail"])))
    return spark.createDataFrame(rows, "order_date string, revenue double, units long, region string, channel string")


def sensors(spark: SparkSession) -> DataFrame:
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        stamp = datetime(2024, 1, 1) + timedelta(hours=i)
        rows.append((f"ST{i:04d}", rnd.uniform(50, 58.5), rnd.uniform(-6, 1.7), stamp.strftime("%Y-%m-%d %H:%M:%S"),
                     rnd.gammavariate(2, 6), rnd.uniform(5, 80), rnd.choice("ABC")))
    return spark.createDataFrame(
        rows, "station_id string, latitude double, longitude double, reading_ts string, pm25 double, latency double, sensor_type string")


def employees(spark: SparkSession) -> DataFrame:
    rnd = random.Random(9)
    rows = [
        (1000 + i, rnd.choice(["Ops", "Sales", "HR", "IT", "Legal"]), rnd.gauss(52000, 14000), rnd.uniform(0, 30), rnd.randint(1, 5),
         f"note number {i} about work")
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "employee_id long, department string, salary double, years_experience double, satisfaction long, notes string")


def messy(spark: SparkSession) -> DataFrame:
    rnd = random.Random(10)
    cities = ["Lyon", "LYON", "Oslo", "oslo "]
    rows = []
    for i in range(200):
        age = -5.0 if i == 7 else 250.0 if i == 9 else float(rnd.randint(20, 60))
        segment = None if 20 <= i < 40 else rnd.choice(["gold", "silver"])
        rows.append((i, cities[i % 4], f"Rs {1000 + i:,}.50", age, segment, None, "NP"))
    rows += rows[:15]
    return spark.createDataFrame(
        rows, "customer_id long, city string, spend string, age double, segment string, notes string, region_code string")
