import pytest
import samples
from pyspark.sql import functions as F

from tablescry.operators import quality as qu
from tablescry.operators.profile import profile_table


@pytest.fixture(scope="module")
def issues(spark):
    return [r.asDict() for r in qu.health_issues(samples.messy(spark)).collect()]


def test_one_of_every_fault(issues):
    ids = {i["id"] for i in issues}
    assert {
        "duplicate_rows:", "missing_values:segment", "empty_column:notes", "numeric_as_text:spend", "whitespace:city",
        "category_variants:city", "constant_column:region_code", "impossible_values:age", "outliers:age"} <= ids


def test_numbers_of_the_faults(issues):
    by = {i["id"]: i for i in issues}
    assert by["duplicate_rows:"]["n_affected"] == 15 and by["duplicate_rows:"]["severity"] == "critical"
    assert by["numeric_as_text:spend"]["n_affected"] == 215
    assert by["impossible_values:age"]["fix_params"] == {"low": "0.0", "high": "130.0"}
    assert by["missing_values:segment"]["fix_params"] == {"strategy": "label", "value": "Unknown"}
    assert by["empty_column:notes"]["pct_affected"] == 100.0


def test_score_is_what_the_penalties_leave(spark, issues):
    report = qu.health(samples.messy(spark))[1].first()
    assert report["score"] == pytest.approx(max(0.0, 100 - sum(i["penalty"] for i in issues)), abs=0.05)
    assert report["n_issues"] == len(issues)
    assert all(0 < i["penalty"] <= qu.PENALTY_CEILING[i["kind"]] for i in issues)


def test_order(issues):
    rank = {"critical": 0, "warning": 1, "notice": 2}
    keys = [(rank[i["severity"]], -i["pct_affected"]) for i in issues]
    assert keys == sorted(keys)


def test_tidy_table(spark):
    df = spark.range(50).select("id", (F.col("id") * 1.7).alias("b"), F.concat(F.lit("row "), F.col("id").cast("string"), F.lit("x y z words")).alias("c"))
    issues, report = qu.health(df)
    assert report.first()["score"] >= 90 and report.first()["n_critical"] == 0
    assert qu.passed_checks(issues).count() >= 9


def test_unread_spellings_are_not_passed(spark):
    few = spark.range(500).select(F.concat(F.lit("name "), (F.col("id") % 401).cast("string")).alias("c"))
    known = profile_table(few, "sketch", audit=True)
    issues = qu.health_issues(few, known)
    assert "category_variants" not in {r["check"] for r in qu.passed_checks(issues, known).collect()}
    assert "category_variants" not in {r["check"] for r in qu.passed_checks(issues).collect()}


def test_empty_table_scores_zero(spark):
    report = qu.health(spark.createDataFrame([], "a long"))[1].first()
    assert report["score"] == 0.0 and report["grade"] == "Critical" and report["n_issues"] == 0


def test_equal_values_in_other_places_are_no_duplicate_rows(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", "a"), (None, None), (None, None)], "x string, y string")
    assert qu.duplicate_rows(df).first()["n_duplicates"] == 2


def test_duplicate_columns_need_equal_rows_not_equal_multisets(spark):
    df = spark.range(40).select("id", F.col("id").alias("again"), (39 - F.col("id")).alias("reversed"))
    assert qu.duplicate_column_pairs(df, profile_table(df, audit=True)) == [("again", "id")]


def test_mixed_types(spark):
    df = spark.range(100).select(F.when(F.col("id") < 30, F.col("id").cast("string")).otherwise(F.concat(F.lit("word"), F.char(F.lit(97) + F.col("id") % 20))).alias("m"))
    issue = qu.health_issues(df, checks=["mixed_types"]).first()
    assert issue["n_affected"] == 30 and issue["fix_action"] is None and issue["evidence"]["examples"] == '["0", "1", "10"]'


def test_codes_are_not_numbers_and_ids_are_left_alone(spark):
    df = spark.range(60).select(F.concat(F.lit("Item "), F.col("id").cast("string")).alias("code"), F.concat(F.lit("$"), F.col("id").cast("string")).alias("order_id"))
    assert qu.health_issues(df, checks=["numeric_as_text"]).count() == 0


def test_copies_of_one_row_fill_a_third_of_the_table(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    assert qu.duplicate_rows(df.repartition(8)).first()["n_duplicates"] == 999


@pytest.mark.parametrize("score, expected", [(90.0, "Excellent"), (89.9, "Good"), (60.0, "Fair"), (40.0, "Poor"), (39.9, "Critical")])
def test_grades(spark, score, expected):
    assert spark.range(1).select(qu.grade(F.lit(score)).alias("g")).first()["g"] == expected
