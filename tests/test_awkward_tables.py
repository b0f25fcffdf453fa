"""Names with dots, infinities, repeated keys, map columns and files that need care."""

import pytest
from pyspark.sql import functions as F

from tablescry.operators import aggregates, correlation, profile, quality, textjobs, timeseries
from tablescry.sources import csv, tables


def test_every_step_takes_dotted_names(spark):
    rows = [(i, "x" if i % 2 else "y", float(i % 17), f"2024-01-{1 + i % 28:02d}", i % 5 * 1.5) for i in range(120)]
    df = spark.createDataFrame(rows, "`a` long, `a.1` string, `b.c` double, `d.t` string, `m.x` double")
    assert [r.column for r in profile.profile(df).collect()] == df.columns
    assert quality.health_issues(df).count() >= 0
    assert correlation.correlation_matrix(df, ["b.c", "m.x"]).count() == 4
    assert timeseries.trends(df, "d.t", ["b.c", "m.x"], min_pct=0.0).count() == 2
    assert aggregates.segments(df, ["a.1"], "b.c", min_gap_pct=0.0).first().category == "a.1"


def test_spread_of_numbers_in_text(spark):
    rows = [(f"{1e9 + i:.0f}",) for i in range(300)]
    found = profile.profile_table(spark.createDataFrame(rows, "n string")).facts.columns["n"]
    assert found["std"] == pytest.approx(86.7467, abs=1e-3)


def test_each_row_is_grounded_by_itself(spark):
    texts = spark.createDataFrame([(None, "has 777"), (None, "nothing"), ("k", "-20"), ("k", "20 99")], "key string, t string")
    allowed = spark.createDataFrame([(20.0,), (None,)], "number double")
    got = sorted(tuple(r) for r in textjobs.grounding_audit(texts, "t", ["key"], allowed).na.fill("none", "key").collect())
    assert got == [("k", 1, 0, True), ("k", 2, 1, False), ("none", 0, 0, True), ("none", 1, 1, False)]


def test_maps_tell_rows_apart(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (1, {"a": 2})], "k int, m map<string,int>")
    assert quality.duplicate_rows(df).first().n_duplicates == 1


def test_columns_alike_are_confirmed(spark):
    bits = spark.range(64).select(*[(F.shiftright("id", j) % 2 == 1).alias(f"b{j}") for j in range(6)])
    df = bits.withColumn("again", F.col("b3")).withColumn("and_again", F.col("b3"))
    pairs = quality.duplicate_column_pairs(df, profile.profile_table(df, "sketch", audit=True))
    assert pairs == [("again", "b3"), ("and_again", "b3")]


def test_files_keep_broken_lines_and_their_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('a,a,b.c\n1,"x\ny",café �\n2,z,w\n'.encode())
    (tmp_path / "b.csv").write_bytes("a,a,b.c\n3,q,café\n".encode("latin-1"))
    rows = sorted(tuple(r) for r in csv.read_csv_table(spark, str(tmp_path)).collect())
    assert rows == [(1, "x\ny", "café �"), (2, "z", "w"), (3, "q", "café")]


def test_records_keep_microseconds(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.000678' AS t UNION ALL SELECT timestamp_ntz'2024-01-02 03:04:05'")
    assert sorted(r.t for r in tables.as_records(df).collect()) == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000678"]
