from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablescry.functions import names, scalars as sc


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    values = ["12", " 1.5 ", "-3e2", "12d", "0x1p3", "1,200", "NaN", "Infinity", "", None, ".5", "5.", "abc"]
    got = one(spark, values, lambda c: sc.to_number(c, sc.T.StringType()))
    assert got == [12.0, 1.5, -300.0, None, None, None, None, None, None, None, 0.5, 5.0, None]
    assert one(spark, [1.0, float("nan"), None], lambda c: sc.to_number(c, sc.T.DoubleType()), "double") == [1.0, None, None]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-31", datetime(2024, 1, 31)),
    ("2024-1-5 03:04:05", datetime(2024, 1, 5, 3, 4, 5)),
    ("2024-01-05T03:04:05.250", datetime(2024, 1, 5, 3, 4, 5, 250000)),
    ("04/01/2023", datetime(2023, 4, 1)),
    ("31/01/2023", datetime(2023, 1, 31)),
    ("31-01-2023 10:30", datetime(2023, 1, 31, 10, 30)),
    ("2023/02/03", datetime(2023, 2, 3)),
    ("20230203", datetime(2023, 2, 3)),
    ("5 Jan 2023", datetime(2023, 1, 5)),
    ("January 5, 2023", datetime(2023, 1, 5)),
    ("Sept 9th, 2021", datetime(2021, 9, 9)),
    (" 2024-01-31 ", datetime(2024, 1, 31)),
    ("2023-02-30", None), ("32/13/2023", None), ("N/A", None), ("ST0004", None), ("maybe 5 people", None), ("", None),
])
def test_dates(spark, text, expected):
    assert one(spark, [text], sc.parse_stamp) == [expected]


def test_white_space_of_every_kind_is_stripped(spark):
    assert one(spark, ["\t a b \n", " x", "  ", None], sc.strip_ws) == ["a b", "x", "", None]


def test_missing_words(spark):
    assert one(spark, [" N/A ", "Unknown", "-", "--", "Nancy", None], sc.is_missing_word) == [True, True, False, True, False, None]


def marker(values, start=True):
    texts = values if start else [v[::-1] for v in values]
    return sc.shared_marker(min(texts), max(texts), min(map(len, values)), start)


def test_markers_are_short_and_shared():
    assert marker(["Rs 1,200.50", "Rs 5"]) == "Rs "
    assert marker(["Item 5", "Item 12"]) == "Ite"[:3]
    assert marker(["$5", "7"]) == ""
    assert marker(["12 kg", "7 kg"], start=False) == " kg"
    assert marker(["100", "101"]) == ""


def test_decorated_numbers(spark):
    def read(values):
        prefix = marker(values)
        rest = [v[len(prefix):] for v in values]
        tails = [v[::-1] for v in rest]
        suffix = sc.shared_marker(min(tails), max(tails), min(map(len, rest)), False)
        return one(spark, values, lambda c: sc.undecorated_number(c, prefix, suffix))

    assert read(["Rs 1,200.50", "Rs 3"]) == [1200.5, 3.0]
    assert read(["$1,200", "$5"]) == [1200.0, 5.0]
    assert read(["12 kg", "8 kg"]) == [12.0, 8.0]
    assert read(["45%", "7%"]) == [45.0, 7.0]
    assert read(["Item 5", "Item 12"]) == [None, None]


def test_percent_change(spark):
    df = spark.createDataFrame([(10.0, 15.0), (-10.0, -5.0), (0.0, 3.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(sc.pct_change(F.col("a"), F.col("b"))).collect()] == [50.0, 50.0, None, None, None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "Revenue int, region int")
    assert names.resolve_column(df, "revenue") == "Revenue"
    with pytest.raises(names.ColumnNotFound, match="margin"):
        names.resolve_column(df, "margin")
    assert names.is_identifier("order_id") and names.is_identifier("ID") and not names.is_identifier("c_custkey")
    assert not names.is_identifier("zip_code") and names.is_identifier("zip_code", names.ID_NAME_FINDINGS)
    assert names.is_identifier("Unnamed: 0", names.ID_NAME_AUDIT)
    assert names.default_aggregate("total_spend") == "sum" and names.default_aggregate("salary") == "mean"
    assert names.aggregate_name("Average") == "mean" and names.aggregate_name(None) == "mean"
    with pytest.raises(names.NotCalculable):
        names.aggregate_name("eval")
    assert names.plausible_range("age_years") == (0.0, 130.0)
    assert names.plausible_range("tax_rate") == (-100.0, 100.0)
    assert names.plausible_range("unit_price") == (0.0, None)
    assert names.plausible_range("page") is None
