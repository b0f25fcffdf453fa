import pytest
import samples

from tablescry.operators import cleaning as cl, quality as qu


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fix_everything_and_again(spark):
    df = samples.messy(spark)
    before = rows(df)
    steps = cl.plan_clean(qu.health_issues(df))
    cleaned, receipt = cl.clean(df, steps)
    assert rows(df) == before
    assert "notes" not in cleaned.columns and "region_code" not in cleaned.columns
    assert dict(cleaned.dtypes)["spend"] == "double"
    left = {r["kind"] for r in qu.health_issues(cleaned).collect()}
    # The label "Unknown" is itself one of the words for missing, so that issue stays.
    assert not left & {"duplicate_rows", "empty_column", "whitespace", "category_variants", "numeric_as_text", "impossible_values"}
    again, _ = cl.clean(cleaned, cl.plan_clean(qu.health_issues(cleaned)))
    assert rows(cl.clean(again, [{"action": "drop_duplicates"}])[0]) == rows(again)
    order = [cl.APPLY_ORDER.index(r["action"]) for r in receipt.collect()]
    assert order == sorted(order)


def test_approved_ids_only(spark):
    issues = qu.health_issues(samples.messy(spark))
    assert cl.plan_clean(issues, []) == []
    assert [s["action"] for s in cl.plan_clean(issues, ["whitespace:city"])] == ["trim_whitespace"]
    assert len(cl.plan_clean(issues)) == issues.where("fix_action is not null").count()


def test_receipt_counts(spark):
    steps = [{"action": "drop_invalid", "column": "age", "low": 0.0, "high": 130.0}, {"action": "drop_duplicates"},
             {"action": "fill_missing", "column": "segment", "strategy": "label"}]
    cleaned, receipt = cl.clean(samples.messy(spark), steps)
    got = [(r["action"], r["rows_before"], r["rows_after"], r["cells_changed"]) for r in receipt.collect()]
    assert got == [("drop_invalid", 215, 211, 0), ("drop_duplicates", 211, 198, 0), ("fill_missing", 198, 198, 20)]
    assert cleaned.count() == 198


def test_first_copy_survives(spark):
    df = spark.createDataFrame([(5, "a"), (2, "a"), (9, "b"), (1, None), (7, None)], "row long, v string")
    assert rows(cl.drop_duplicates(df, "row")) == sorted([(2, "a"), (9, "b"), (1, None)], key=repr)


@pytest.mark.parametrize("strategy, expected", [("median", 3.0), ("mean", 4.0), ("zero", 0.0)])
def test_fill_with_a_number(spark, strategy, expected):
    df = spark.createDataFrame([(1.0,), (3.0,), (8.0,), (None,)], "x double")
    cleaned, receipt = cl.clean(df, [{"action": "fill_missing", "column": "x", "strategy": strategy}])
    assert rows(cleaned) == sorted([(1.0,), (3.0,), (8.0,), (expected,)], key=repr)
    assert receipt.first()["cells_changed"] == 1


def test_label_becomes_median_once_the_column_is_a_number(spark):
    df = spark.createDataFrame([("$1",), ("$3",), (None,), ("$8",)], "x string")
    steps = [{"action": "fill_missing", "column": "x", "strategy": "label"}, {"action": "to_numeric", "column": "x"}]
    assert rows(cl.clean(df, steps)[0]) == [(1.0,), (3.0,), (3.0,), (8.0,)]


def test_step_on_a_dropped_column_is_left_out(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    cleaned, receipt = cl.clean(df, [{"action": "fill_missing", "column": "x", "strategy": "label"}, {"action": "drop_column", "column": "x"}])
    assert cleaned.columns == ["y"] and [r["action"] for r in receipt.collect()] == ["drop_column"]


@pytest.mark.parametrize("step", [
    {"action": "explode"}, {"action": "drop_column", "column": "x"}, {"action": "drop_invalid", "column": "x"},
    {"action": "merge_categories", "column": "x"}, {"action": "trim_whitespace", "column": "n"}, {"action": "to_numeric", "column": "x"},
    {"action": "fill_missing", "column": "x", "strategy": "magic"}, {"action": "fill_missing", "column": "x", "strategy": "median"}])
def test_refusals(spark, step):
    df = spark.createDataFrame([("a", 1)], "x string, n int").drop("n") if step["action"] == "drop_column" else spark.createDataFrame([("a", 1)], "x string, n int")
    with pytest.raises(cl.NotCalculable):
        cl.clean(df, [step])


def test_cap_keeps_nulls_and_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(40)] + [(1e6,), (None,)], "x double")
    cleaned, receipt = cl.clean(df, [{"action": "cap_outliers", "column": "x"}])
    got = [r["x"] for r in cleaned.collect()]
    assert len(got) == 42 and None in got and max(v for v in got if v is not None) < 200
    assert receipt.first()["cells_changed"] == 1


@pytest.mark.parametrize("chunks, rows_each", [(3, 1_000_000), (1000, 1_000_000), (4, 7), (2, 1)])
def test_forward_fill_against_brute_force(spark, monkeypatch, chunks, rows_each):
    monkeypatch.setattr(cl, "CHUNKS", chunks)
    monkeypatch.setattr(cl, "CHUNK_ROWS", rows_each)
    data = [(i, i % 4, float(i) if (i * 7) % 11 < 3 and i > 6 else None) for i in range(200)]
    df = spark.createDataFrame(data, "i long, k long, v double").repartition(5)

    def brute(part):
        known, out = None, []
        first = next(v for _, _, v in part if v is not None)
        for i, k, v in part:
            known = v if v is not None else known
            out.append((i, k, first if known is None else known))
        return out

    assert sorted(map(tuple, cl.forward_fill(df, "v", "i").collect())) == brute(data)
    loose = df.unionByName(spark.createDataFrame([(None, 1, 5.0), (900, None, None), (901, None, 2.0)], df.schema))
    filled = {tuple(r) for r in cl.forward_fill(loose, "v", "i", ["k"]).collect()}
    assert len(filled) == 203 and {(None, 1, 5.0), (900, None, 2.0), (901, None, 2.0)} <= filled
    expected = sorted(row for key in range(4) for row in brute([d for d in data if d[1] == key]))
    assert sorted(map(tuple, cl.forward_fill(df, "v", "i", ["k"]).collect())) == expected


@pytest.mark.parametrize("chunks, rows_each", [(1000, 1_000_000), (4, 7), (20, 3), (2, 1)])
def test_forward_fill_of_ties_and_null_order_values(spark, monkeypatch, chunks, rows_each):
    import hashlib

    monkeypatch.setattr(cl, "CHUNKS", chunks)
    monkeypatch.setattr(cl, "CHUNK_ROWS", rows_each)
    for days in ([7.0], [None], [None, 1.0, 7.0, 7.0, 7.0, 7.0, 9.0]):
        data = [(i, days[i * 5 % len(days)], float(i) if i % 9 == 4 else None) for i in range(150)]
        df = spark.createDataFrame(data, "i long, day double, v double").repartition(4)
        known, expected = None, []
        for i, day, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(str(r[0]).encode()).hexdigest())):
            known = v if v is not None else known
            expected.append((i, known))
        first = next(v for _, v in expected if v is not None)
        got = sorted((r["i"], r["v"]) for r in cl.forward_fill(df, "v", "day", ties=["i"]).collect())
        assert got == sorted((i, first if v is None else v) for i, v in expected)


def test_fill_by_time_across_a_clock_change(spark):
    from datetime import datetime, timedelta

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = datetime(2024, 3, 9, 20)
        data = [(start + timedelta(minutes=15 * i), float(i) if i % 5 == 0 else None) for i in range(60)]
        df = spark.createDataFrame(data, "t timestamp_ntz, v double").repartition(4)
        got = [(r["t"], r["v"]) for r in cl.forward_fill(df, "v", "t").orderBy("t").collect()]
        assert got == [(t, float(i - i % 5)) for i, (t, _) in enumerate(data)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
