from datetime import date, datetime, timedelta

import pytest
import samples

from tablescry.functions.names import NotCalculable
from tablescry.operators import forecast as fc, timeseries as ts


def table(spark, values, start=datetime(2024, 1, 1)):
    return spark.createDataFrame([(start + timedelta(days=i), v) for i, v in enumerate(values)], "t timestamp_ntz, v double")


def pairs(df):
    return [(r["period"], r["value"]) for r in df.orderBy("period").collect()]


def test_labels_and_complete_grid(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31), 1.0), (datetime(2024, 2, 4), 3.0), (datetime(2024, 4, 1), 5.0)], "t timestamp_ntz, v double")
    assert pairs(ts.resample(df, "t", "v", "M", "mean")) == [
        (date(2024, 1, 31), 1.0), (date(2024, 2, 29), 3.0), (date(2024, 3, 31), None), (date(2024, 4, 30), 5.0)]
    weeks = pairs(ts.resample(df, "t", "v", "W", "sum"))
    assert weeks[0] == (date(2024, 2, 4), 4.0) and weeks[-1] == (date(2024, 4, 7), 5.0)
    assert len(weeks) == 10 and all(p.weekday() == 6 for p, _ in weeks) and weeks[1][1] == 0.0
    days = pairs(ts.resample(df, "t", "v", "D", "count"))
    assert len(days) == 62 and sum(v for _, v in days) == 3.0


def test_one_crash_does_not_turn_a_rise(spark):
    series = ts.resample(table(spark, [float(i) for i in range(59)] + [-500.0]), "t", "v", "D")
    row = ts.trend_slope(series).first()
    assert row["slope"] < 0 or row["direction"] == "rising"
    rising = ts.trend_slope(ts.resample(table(spark, [float(i) for i in range(60)]), "t", "v", "D")).first()
    assert (rising["direction"], rising["slope"]) == ("rising", pytest.approx(1.0))


def test_slope_bands(spark):
    def of(values):
        return ts.trend_slope(ts.resample(table(spark, values), "t", "v", "D")).first()["direction"]

    assert of([5.0] * 30) == "flat" and of([100 + i * 0.01 for i in range(30)]) == "flat"
    assert of([30.0 - i for i in range(30)]) == "falling" and of([4.0]) == "unknown"


def test_thirds_peak_and_low(spark):
    row = ts.trend_thirds(ts.resample(table(spark, [1.0, 1.0, 1.0, 9.0, 0.0, 4.0, 2.0, 2.0, 2.0]), "t", "v", "D")).first()
    assert (row["start_average"], row["end_average"], row["change_pct"], row["direction"]) == (1.0, 2.0, 100.0, "up")
    assert (row["peak_period"], row["low_period"]) == (date(2024, 1, 4), date(2024, 1, 5))


def test_too_little_data(spark):
    for df in (table(spark, []), spark.createDataFrame([("junk", 1.0)], "t string, v double"), table(spark, [None, None])):
        series = ts.resample(df, "t", "v", "D")
        assert series.count() == 0 and ts.trend_thirds(series).count() == 0
        assert ts.suggest_freq(df, "t").first()["freq"] == "D"
    with pytest.raises(NotCalculable):
        ts.resample(table(spark, [1.0]), "t", "v", "Q")


def test_rolling_mean_skips_gaps(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 2.0), (datetime(2024, 1, 3), 4.0)], "t timestamp_ntz, v double")
    got = [r["rolling_mean"] for r in ts.rolling_mean(ts.resample(df, "t", "v", "D"), 2).orderBy("period").collect()]
    assert got == [2.0, 2.0, 4.0]


def test_mixed_date_text(spark):
    stats = ts.series_stats(ts.resample(samples.daily_sales(spark), "order_date", "revenue", "D")).first()
    assert stats["n_observed"] <= 397 and stats["n_periods"] >= stats["n_observed"]


def test_lags_never_see_today(spark):
    series = fc.daily_series(table(spark, [float(i * i) for i in range(20)]), "t", "v")
    row = fc.lag_features(series).orderBy("period").first()
    assert (row["y"], row["lag_1"], row["lag_7"]) == (49.0, 36.0, 0.0)
    assert row["rolling_mean_7"] == pytest.approx(sum(i * i for i in range(7)) / 7)
    assert (row["day_of_week"], row["month"]) == (0, 1)


def test_split_is_chronological(spark):
    split = fc.chrono_split(fc.lag_features(fc.daily_series(table(spark, [float(i) for i in range(57)]), "t", "v"))).collect()
    train, test = [r["period"] for r in split if r["is_train"]], [r["period"] for r in split if not r["is_train"]]
    assert len(train) == 40 and len(test) == 10 and max(train) < min(test)


def test_short_series_declined(spark):
    result = fc.forecast(table(spark, [float(i) for i in range(20)]), "t", "v")
    assert result["status"] == "insufficient_data" and "future" not in result
    with pytest.raises(NotCalculable):
        fc.forecast(table(spark, [1.0]), "t", "v", 0)


def test_verdict_agrees_with_errors(spark, monkeypatch):
    import random

    monkeypatch.setattr(fc, "TREES", 10)
    rnd, level, walk = random.Random(4), 0.0, []
    for _ in range(120):
        level += rnd.gauss(0, 1)
        walk.append(level)
    result = fc.forecast(table(spark, walk), "t", "v", 5)
    m = result["metrics"].first()
    assert m["status"] == "ok" and m["beats_baseline"] == (m["test_mae"] < m["baseline_mae"])
    assert m["improvement_pct"] == pytest.approx(100 * (m["baseline_mae"] - m["test_mae"]) / m["baseline_mae"])
    assert (m["n_train"], m["n_test"]) == (90, 23)
    future = result["future"].orderBy("step").collect()
    assert [r["period"] for r in future] == [date(2024, 4, 30) + timedelta(days=i) for i in range(5)]
    assert result["predictions"].count() == 23
    assert sum(r["importance"] for r in result["importances"].collect()) == pytest.approx(1.0)
