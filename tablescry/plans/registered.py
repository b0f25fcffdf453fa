"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame.

Doubles are rounded at the very end, so that two engines that add in another
order still agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.functions.scalars import is_missing_word, pct_change, strip_ws, variant_key
from tablescry.operators import (
    aggregates as ag,
    anomalies as an,
    chartdata as ch,
    cleaning as cl,
    comparison as cp,
    correlation as co,
    findings as fi,
    forecast as fc,
    forests as fo,
    geo as ge,
    profile as pr,
    quality as qu,
    quantiles as qt,
    routing as ro,
    textjobs as tx,
    timeseries as ts,
    value_counts as vc,
    whatif as wi,
)
from tablescry.plans import analyse as al
from tablescry.plans.derived import load, messy_customers, placed_customers, scratch_folder, sparse_events, story_orders, written_dates
from tablescry.sources import csv as sc
from tablescry.sources import tables as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def whole(df: DataFrame) -> DataFrame:
    """Integers of every width as long."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, T.IntegralType) else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    return whole(rounded(df, digits))


# ------------------------------------------------------------ sources, sinks --
@query
def csv_round_trip(spark, folder):
    """Write a table as CSV, read it back as text, infer its types."""
    path = scratch_folder(spark) + "/customers"
    st.write_csv(load(spark, folder, "customer"), path)
    return tidy(sc.read_csv_table(spark, path))


@query
def csv_with_line_breaks(spark, folder):
    """Cells of several lines and with quotes, written as CSV and read back by many tasks."""
    path = scratch_folder(spark) + "/notes"
    key = F.col("c_custkey")
    note = F.when(key % 3 == 0, F.concat_ws("\n", "c_name", F.lit('said "no", twice'), "c_mktsegment")).when(key % 3 == 1, F.concat(F.lit("\n,"), F.col("c_name"))).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" ")))
    st.write_csv(load(spark, folder, "customer").select("c_custkey", note.alias("note"), "c_acctbal"), path)
    return tidy(sc.read_csv_table(spark, path))


@query
def dotted_names_profile(spark, folder):
    """A file whose header repeats a name and holds dots, read back and profiled."""
    path = scratch_folder(spark) + "/customers"
    named = load(spark, folder, "customer").select(
        F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("a.1"), F.col("c_acctbal").alias("b.c"), F.col("c_name").alias("d.e.f"))
    st.write_csv(named, path)
    return tidy(pr.profile(sc.read_csv_table(spark, path)).select("column", "n_null", "n_unique", "min", "max", "mean"))


@query
def dotted_names_audit(spark, folder):
    """Duplicate rows and gaps of a table with dots in its names."""
    table = load(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("a.1"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("b.c"))
    issues = qu.health_issues(table, checks=["duplicate_rows", "missing_values"])
    return tidy(issues.select("kind", F.array_join("columns", ",").alias("columns"), "n_affected"))


@query
def infer_column_types(spark, folder):
    """Types recovered from a table whose every cell was turned into text."""
    o = load(spark, folder, "orders")
    text = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])
    return tidy(sc.infer_types(text).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")))


@query
def preview_rows(spark, folder):
    return tidy(st.preview(load(spark, folder, "orders"), 200, ["o_orderkey"]))


@query
def json_records(spark, folder):
    return tidy(st.as_records(load(spark, folder, "orders")))


@query
def dataset_summaries(spark, folder):
    tables = {"story": story_orders(spark, folder), "messy": messy_customers(spark, folder)}
    return tidy(st.dataset_summary(tables, cleaned=["story"]))


@query
def kept_original(spark, folder):
    """Rows and total of the original and the cleaned version, both read back."""
    root = scratch_folder(spark)
    df = messy_customers(spark, folder).select("customer_ref", "age", "gappy")
    st.save_version(df, root, "original")
    cleaned, _ = cl.clean(df, [{"action": "drop_invalid", "column": "age", "low": 0.0, "high": 130.0}])
    st.save_version(cleaned, root, "cleaned")
    def summed(version, label):
        return st.read_version(spark, root, version).agg(F.count("*").alias("n"), F.sum("age").alias("total")).select(F.lit(label).alias("version"), "n", "total")
    return rounded(summed("original", "original").unionByName(summed(None, "current")))


# ------------------------------------------------------- coercion, text rules --
@query
def parse_mixed_dates(spark, folder):
    df = written_dates(spark, folder)
    return df.select("o_orderkey", F.to_date(ag.stamp_of(df, "written")).alias("day"))


@query
def undecorated_numbers(spark, folder):
    df = messy_customers(spark, folder).select("customer_ref", "spend")
    known = pr.profile_table(df, "sketch", audit=True)
    prefix, suffix = qu.number_markers(known, "spend")
    return tidy(df.select("customer_ref", F.lit(prefix).alias("prefix"), qu.undecorated_number(F.col("spend"), prefix, suffix).alias("number")))


@query
def missing_words(spark, folder):
    return messy_customers(spark, folder).groupBy("segment").agg(F.count_if(is_missing_word(F.col("segment"))).alias("n_missing_words"))


@query
def spelling_keys(spark, folder):
    df = messy_customers(spark, folder)
    return df.groupBy(variant_key(strip_ws(F.col("city"))).alias("spelling_key")).agg(
        F.count_distinct("city").alias("n_spellings"), F.count("*").alias("n"))


@query
def yearly_percent_change(spark, folder):
    o = load(spark, folder, "orders")
    years = o.groupBy("o_orderstatus").agg(
        F.sum(F.when(F.year("o_orderdate") == 1996, F.col("o_totalprice"))).alias("before"),
        F.sum(F.when(F.year("o_orderdate") == 1997, F.col("o_totalprice"))).alias("after"))
    return rounded(years.select("o_orderstatus", pct_change(F.col("before"), F.col("after")).alias("pct_change")))


# --------------------------------------------------------- profile and roles --
PROFILE = ["column", "semantic_type", "n_null", "null_pct", "n_unique", "min", "max", "mean", "min_date", "max_date"]


@query
def profile_customer(spark, folder):
    return tidy(pr.profile(load(spark, folder, "customer")).select(PROFILE))


@query
def profile_lineitem(spark, folder):
    return tidy(pr.profile(load(spark, folder, "lineitem")).select(PROFILE))


@query
def profile_events(spark, folder):
    return tidy(pr.profile(load(spark, folder, "events")).select(PROFILE))


@query
def profile_documents(spark, folder):
    return tidy(pr.profile(load(spark, folder, "documents")).select(PROFILE))


@query
def profile_flags(spark, folder):
    return tidy(pr.profile_flags(load(spark, folder, "lineitem")))


@query
def top_values(spark, folder):
    return tidy(pr.top_value_rows(pr.profile(load(spark, folder, "orders"), "sketch")))


@query
def compact_profile(spark, folder):
    return tidy(pr.compact_profile(pr.profile(load(spark, folder, "part"))))


@query
def column_kinds(spark, folder):
    return tidy(pr.shape(pr.profile(load(spark, folder, "lineitem"), "sketch")))


@query
def value_count_table(spark, folder):
    return tidy(vc.value_counts(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query
def route_time_series(spark, folder):
    return ro.route(load(spark, folder, "orders"))


@query
def route_geo(spark, folder):
    return ro.route(placed_customers(spark, folder))


@query
def route_tabular(spark, folder):
    return ro.route(load(spark, folder, "part"))


@query
def measure_ranking(spark, folder):
    return tidy(ro.measure_ranking(load(spark, folder, "part")))


@query
def category_spread(spark, folder):
    return tidy(ro.category_spread(load(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_discount"], "l_extendedprice"), 6)


@query
def best_pair(spark, folder):
    return tidy(co.best_pair(load(spark, folder, "part"), ["p_partkey", "p_size", "p_retailprice"]), 6)


# ----------------------------------------------------- summaries and filters --
@query
def aggregate_total(spark, folder):
    return tidy(ag.aggregate(load(spark, folder, "lineitem"), "L_ExtendedPrice", "total"), 2)


@query
def aggregate_median(spark, folder):
    return tidy(ag.aggregate(messy_customers(spark, folder), "gappy", "median"))


@query
def rank_groups(spark, folder):
    return tidy(ag.rank_groups(load(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", "sum"), 2)


@query
def rank_hundred_groups(spark, folder):
    return tidy(ag.rank_groups(load(spark, folder, "lineitem"), "l_partkey", "l_quantity", "sum", 100))


@query
def rank_groups_by_median(spark, folder):
    return tidy(ag.rank_groups(load(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice", "median", 25, "bottom"))


@query
def count_where(spark, folder):
    return tidy(ag.count_where(messy_customers(spark, folder), "city", " PORT alba "))


@query
def usable_rows(spark, folder):
    df = written_dates(spark, folder)
    return tidy(ag.drop_unusable(df, {"when": ag.stamp_of(df, "written"), "price": ag.number_of(df, "o_totalprice")})[1])


@query
def time_range_filter(spark, folder):
    inside = ag.in_time_range(load(spark, folder, "orders"), "o_orderdate", "1997-01-01", "1997-12-31")
    return tidy(inside.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query
def top_value_filter(spark, folder):
    kept = ag.keep_top_values(load(spark, folder, "part"), "p_type", 2)
    return tidy(kept.groupBy("p_type").agg(F.count("*").alias("n")))


@query
def out_of_range(spark, folder):
    df = messy_customers(spark, folder)
    return tidy(df.where(ag.outside(F.col("age"), 0.0, 130.0)).groupBy("age").agg(F.count("*").alias("n")))


@query
def describe_number(spark, folder):
    return tidy(ag.describe_number(load(spark, folder, "lineitem"), "l_extendedprice"))


@query
def describe_category(spark, folder):
    return tidy(ag.describe_category(messy_customers(spark, folder), "segment"))


@query
def summary_stats(spark, folder):
    return tidy(ag.summary_stats(load(spark, folder, "lineitem"), "l_extendedprice"))


@query
def category_counts(spark, folder):
    return tidy(vc.category_counts(load(spark, folder, "part"), "p_brand"))


@query
def quantiles(spark, folder):
    return tidy(ag.quantiles(load(spark, folder, "lineitem"), MEASURES, [0.1, 0.25, 0.5, 0.75, 0.9]))


@query
def quantiles_of_large_groups(spark, folder):
    """Over a million rows a key at sf0.1; one key is null and the key's name has a dot."""
    items = load(spark, folder, "lineitem")
    side = items.select(F.nullif("l_linestatus", F.lit("O")).alias("line.status"), F.explode(F.array(*MEASURES)).alias("v"))
    return tidy(qt.exact_quantiles(side, ["line.status"], [0.01, 0.5, 0.999]))


@query
def distinct_days(spark, folder):
    return tidy(load(spark, folder, "lineitem").agg(F.count_distinct(F.to_date("l_shipdate")).alias("n_days")))


@query
def overview(spark, folder):
    return tidy(ag.overview(load(spark, folder, "orders")))


@query
def kpis(spark, folder):
    return tidy(ag.kpis(load(spark, folder, "part")), 2)


@query
def kpis_of_categories(spark, folder):
    return tidy(ag.kpis(load(spark, folder, "part").select("p_brand", "p_type")), 2)


@query
def segments(spark, folder):
    return tidy(ag.segments(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", min_gap_pct=0.0))


@query
def row_sample(spark, folder):
    """The seeded sample is a feature of its own; its size is what can be checked."""
    return ag.row_sample(load(spark, folder, "lineitem"), 4000, ["l_orderkey", "l_linenumber", "l_partkey"])


# ----------------------------------------------------- correlation and fits --
@query
def correlation_matrix(spark, folder):
    return tidy(co.correlation_matrix(load(spark, folder, "lineitem"), MEASURES), 6)


WIDE_COLUMNS = [f"x{i}" for i in range(15)]


@query
def correlation_matrix_wide(spark, folder):
    """Fifteen columns give fifteen columns."""
    primes = (97, 101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163, 167)
    wide = load(spark, folder, "lineitem").select(*[(F.col("l_orderkey") * p % 1009 + F.col("l_quantity") * (p % 7)).cast("double").alias(c) for c, p in zip(WIDE_COLUMNS, primes)])
    return tidy(co.correlation_matrix(wide, WIDE_COLUMNS), 6)


def _with_infinities(spark, folder):
    endless = F.when(F.col("l_orderkey") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return load(spark, folder, "lineitem").select(
        F.when(F.col("l_orderkey") % 97 == 0, endless).otherwise(F.col("l_extendedprice").cast("double")).alias("price"), F.col("l_quantity").cast("double").alias("quantity"))


@query
def correlation_with_infinities(spark, folder):
    return tidy(co.correlation_pairs(_with_infinities(spark, folder), ["price", "quantity"]), 6)


@query
def quantiles_with_infinities(spark, folder):
    return tidy(ag.quantiles(_with_infinities(spark, folder), ["price"], [0.1, 0.5, 0.9]))


@query
def histogram_with_infinities(spark, folder):
    return tidy(ch.histogram(_with_infinities(spark, folder), "price", 8))


@query
def correlation_with_gaps(spark, folder):
    """Pairwise deletion: each pair uses the rows that hold both values."""
    df = messy_customers(spark, folder).select("gappy", "age", "balance", F.when(F.col("customer_ref") % 3 > 0, F.col("customer_ref")).alias("ref"))
    return tidy(co.correlation_pairs(df, ["gappy", "age", "balance", "ref"], 20), 6)


@query
def relationship(spark, folder):
    return tidy(co.relationship(load(spark, folder, "part"), "p_partkey", "p_retailprice"), 6)


@query
def relationships(spark, folder):
    return tidy(co.relationships(load(spark, folder, "part"), ["p_partkey", "p_size", "p_retailprice"], min_r=0.001), 6)


@query
def linear_fit(spark, folder):
    return tidy(co.linear_fit(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


# --------------------------------------------------------------- time series --
@query
def suggest_frequency(spark, folder):
    a = ts.suggest_freq(load(spark, folder, "orders"), "o_orderdate").select(F.lit("orders").alias("source"), "span_days", "freq")
    b = ts.suggest_freq(load(spark, folder, "events"), "ts").select(F.lit("events").alias("source"), "span_days", "freq")
    return tidy(a.unionByName(b))


@query
def resample_daily_mean(spark, folder):
    return tidy(ts.resample(sparse_events(spark, folder), "ts", "value", "D", "mean"))


@query
def resample_weekly_sum(spark, folder):
    return tidy(ts.resample(load(spark, folder, "orders"), "o_orderdate", "o_totalprice", "W", "sum"), 2)


@query
def resample_monthly_median(spark, folder):
    return tidy(ts.resample(load(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice", "M", "median"))


@query
def resample_median_with_null_keys(spark, folder):
    """Items without a flag are a series like the others."""
    flagged = load(spark, folder, "lineitem").select("l_shipdate", "l_extendedprice", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return tidy(ts.resample(flagged, "l_shipdate", "l_extendedprice", "M", "median", ["flag"]).where("value is not null"))


@query
def resample_daily_count(spark, folder):
    return tidy(ts.resample(sparse_events(spark, folder), "ts", "value", "D", "count"))


@query
def rolling_mean(spark, folder):
    return tidy(ts.rolling_mean(ts.resample(sparse_events(spark, folder), "ts", "value", "D", "mean"), 7))


@query
def resample_by_entity(spark, folder):
    return tidy(ts.resample_by_entity(load(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice", "l_discount", "M"), 6)


@query
def trend_slope(spark, folder):
    return tidy(ts.trend_slope(ts.resample(load(spark, folder, "orders"), "o_orderdate", "o_totalprice", "M")))


@query
def trend_thirds(spark, folder):
    return tidy(ts.trend_thirds(ts.resample(load(spark, folder, "orders"), "o_orderdate", "o_totalprice")))


@query
def series_stats(spark, folder):
    return tidy(ts.series_stats(ts.resample(sparse_events(spark, folder), "ts", "value", "D")))


@query
def trends(spark, folder):
    return tidy(ts.trends(load(spark, folder, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"], min_pct=0.0))


@query
def forecast_readiness(spark, folder):
    return tidy(ts.forecast_readiness(load(spark, folder, "orders"), "o_orderdate", "o_totalprice"))


@query
def lag_features(spark, folder):
    return tidy(fc.lag_features(fc.daily_series(load(spark, folder, "orders"), "o_orderdate", "o_totalprice")), 6)


@query
def lag_features_by_type(spark, folder):
    """Many series in one job: gap days carried forward within each event type."""
    return tidy(fc.lag_features(fc.daily_series(sparse_events(spark, folder), "ts", "value", ["event_type"]), ["event_type"]), 6)


@query
def chronological_split(spark, folder):
    features = fc.lag_features(fc.daily_series(load(spark, folder, "orders"), "o_orderdate", "o_totalprice"))
    return tidy(fc.chrono_split(features).groupBy("is_train").agg(F.count("*").alias("n"), F.min("period").alias("first_day"), F.max("period").alias("last_day")))


@query
def naive_baseline(spark, folder):
    features = fc.lag_features(fc.daily_series(load(spark, folder, "orders"), "o_orderdate", "o_totalprice"))
    return tidy(fc.naive_baseline(fc.chrono_split(features)), 2)


@query
def forecast_metrics(spark, folder):
    return tidy(fc.forecast(load(spark, folder, "orders"), "o_orderdate", "o_totalprice", 7, project=False)["metrics"])


@query
def forecast_by_type(spark, folder):
    """What SQL can tell of the forecasts of all event types: sizes, baseline, gaps, and that every projected day lies within the known values."""
    events = sparse_events(spark, folder)
    found = fo.forecast_by_key(events, "ts", "value", ["event_type"], 7)
    known = fc.daily_series(events, "ts", "value", ["event_type"]).groupBy("event_type").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    future = found["future"].join(known, "event_type").groupBy("event_type").agg(
        F.count("predicted").alias("n_projected"), F.bool_and(F.col("predicted").between(F.col("lo"), F.col("hi"))).alias("in_range"))
    metrics = found["metrics"].join(future, "event_type", "left")
    return tidy(metrics.select("event_type", "status", "baseline_mae", "n_train", "n_test", "n_periods", "n_filled", "heavily_filled", "n_projected", "in_range"))


@query
def forecast_future(spark, folder):
    return tidy(fc.forecast(load(spark, folder, "orders"), "o_orderdate", "o_totalprice", 14)["future"])


# ------------------------------------------------------------- quality audit --
ISSUES = ["id", "kind", "severity", "n_affected", "pct_affected", "fix_action", "penalty"]


def _check(name: str) -> Query:
    def run(spark, folder):
        return tidy(qu.health_issues(messy_customers(spark, folder), checks=[name]).select(ISSUES))

    return run


for _name in qu.CHECKS:
    QUERIES[f"audit_{_name}"] = _check(_name)


@query
def health_issues(spark, folder):
    return tidy(qu.health_issues(messy_customers(spark, folder)).select(ISSUES))


@query
def health_score(spark, folder):
    return tidy(qu.health(messy_customers(spark, folder))[1])


@query
def health_score_lineitem(spark, folder):
    return tidy(qu.health(load(spark, folder, "lineitem"))[1])


@query
def health_score_story(spark, folder):
    return tidy(qu.health(story_orders(spark, folder))[1])


@query
def passed_checks(spark, folder):
    story = story_orders(spark, folder)
    known = pr.profile_table(story, "sketch", audit=True)
    return qu.passed_checks(qu.health_issues(story, known), known)


@query
def duplicate_row_count(spark, folder):
    return tidy(qu.duplicate_rows(messy_customers(spark, folder)))


@query
def spelling_variants(spark, folder):
    return tidy(qu.spelling_variants(messy_customers(spark, folder), ["city", "segment"]))


@query
def outlier_fences(spark, folder):
    return tidy(qu.outlier_fences(messy_customers(spark, folder), ["balance", "age"]))


@query
def worst_outliers(spark, folder):
    return tidy(qu.worst_outliers(messy_customers(spark, folder), ["customer_ref"], ["balance", "age"]))


@query
def data_issue_findings(spark, folder):
    return tidy(qu.data_issue_findings(messy_customers(spark, folder)))


# ------------------------------------------------------------------ cleaning --
def _cleaned(spark, folder, *steps, order_by=None):
    return cl.clean(messy_customers(spark, folder), list(steps), order_by)[0]


CITY_SPELLINGS = {
    spelling: f"Port {name}"
    for name in ("Alba", "Bree", "Corr", "Dunn", "Esk")
    for spelling in (f"port {name.lower()}", f"PORT {name.upper()}")
}


@query
def clean_trim_whitespace(spark, folder):
    return _cleaned(spark, folder, {"action": "trim_whitespace", "column": "city"}).groupBy("city").agg(F.count("*").alias("n"))


@query
def clean_merge_categories(spark, folder):
    return _cleaned(spark, folder, {"action": "merge_categories", "column": "city", "mapping": CITY_SPELLINGS}).groupBy("city").agg(F.count("*").alias("n"))


@query
def clean_to_numeric(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "to_numeric", "column": "spend"}).select("customer_ref", "spend"))


@query
def clean_drop_invalid(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "drop_invalid", "column": "age", "low": 0.0, "high": 130.0}).select("customer_ref", "age"))


@query
def clean_cap_outliers(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "cap_outliers", "column": "balance"}).select("customer_ref", "balance"))


@query
def clean_drop_duplicates(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "drop_duplicates"}).select("customer_ref", "city", "age"))


@query
def clean_drop_column(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "drop_column", "column": "notes"}))


@query
def clean_fill_median(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "fill_missing", "column": "gappy", "strategy": "median"}).select("customer_ref", "gappy"))


@query
def clean_fill_mean(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "fill_missing", "column": "gappy", "strategy": "mean"}).select("customer_ref", "gappy"))


@query
def clean_fill_zero(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "fill_missing", "column": "gappy", "strategy": "zero"}).select("customer_ref", "gappy"))


@query
def clean_fill_label(spark, folder):
    return _cleaned(spark, folder, {"action": "fill_missing", "column": "segment", "strategy": "label", "value": "Unknown"}).groupBy("segment").agg(F.count("*").alias("n"))


@query
def clean_fill_drop(spark, folder):
    return tidy(_cleaned(spark, folder, {"action": "fill_missing", "column": "segment", "strategy": "drop"}).select("customer_ref", "segment"))


@query
def clean_fill_forward(spark, folder):
    return tidy(cl.clean(sparse_events(spark, folder), [{"action": "fill_missing", "column": "value", "strategy": "forward"}], "event_id")[0].select("event_id", "value"))


@query
def forward_fill_by_user(spark, folder):
    return tidy(cl.forward_fill(sparse_events(spark, folder), "value", "event_id", ["user_id"]).select("event_id", "user_id", "value"))


@query
def forward_fill_of_ties(spark, folder):
    """Two rows in three have one order value and a few have none: their ids' MD5 settles the order."""
    e = sparse_events(spark, folder)
    day = F.when(F.col("event_id") % 3 != 0, 7.0).when(F.col("event_id") % 10 != 0, (F.col("event_id") % 20).cast("double"))
    return tidy(cl.forward_fill(e.withColumn("day", day), "value", "day", ties=["event_id"]).select("event_id", "value"))


@query
def clean_plan(spark, folder):
    steps = cl.plan_clean(qu.health_issues(messy_customers(spark, folder)))
    rows = [(i, s["action"], s["column"], s["issue_id"]) for i, s in enumerate(steps)]
    return tidy(spark.createDataFrame(rows, "step int, action string, column string, issue_id string"))


RECEIPT_STEPS = [
    {"action": "trim_whitespace", "column": "city"},
    {"action": "merge_categories", "column": "city", "mapping": CITY_SPELLINGS},
    {"action": "to_numeric", "column": "spend"},
    {"action": "drop_column", "column": "notes"},
    {"action": "drop_invalid", "column": "age", "low": 0.0, "high": 130.0},
    {"action": "drop_duplicates"},
    {"action": "fill_missing", "column": "gappy", "strategy": "zero"},
    {"action": "fill_missing", "column": "segment", "strategy": "label", "value": "Unknown"},
]


@query
def clean_receipt(spark, folder):
    return tidy(cl.clean(messy_customers(spark, folder), RECEIPT_STEPS)[1])


@query
def clean_receipt_with_losses(spark, folder):
    """Three in four labels are no numbers, and neither are the words for missing."""
    steps = [{"action": "to_numeric", "column": "label"}, {"action": "trim_whitespace", "column": "city"}]
    return tidy(cl.clean(messy_customers(spark, folder), steps)[1])


@query
def clean_totals(spark, folder):
    return tidy(cl.receipt_totals(cl.clean(messy_customers(spark, folder), RECEIPT_STEPS)[1]))


# ------------------------------------------------------- anomalies, findings --
@query
def anomalies(spark, folder):
    return tidy(an.anomalies(messy_customers(spark, folder), ["balance", "age"], ["customer_ref"]))


@query
def unusual_rows(spark, folder):
    return tidy(an.unusual_rows(messy_customers(spark, folder), ["balance", "age"]).select("customer_ref", "balance", "age"))


@query
def outlier_rows(spark, folder):
    return tidy(an.outlier_rows(load(spark, folder, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 25))


@query
def findings(spark, folder):
    return tidy(fi.findings(story_orders(spark, folder)))


@query
def finding_counts(spark, folder):
    return tidy(fi.finding_counts(fi.all_findings(story_orders(spark, folder))))


@query
def briefing(spark, folder):
    return tidy(al.analyse(story_orders(spark, folder)).briefing)


@query
def analysis_report(spark, folder):
    return tidy(al.analysis_report(load(spark, folder, "lineitem")))


@query
def analysis_report_story(spark, folder):
    return tidy(al.analysis_report(story_orders(spark, folder)))


# ---------------------------------------------------- comparison and what-if --
def _halves(spark, folder):
    o = load(spark, folder, "orders")
    before = o.where("o_orderdate < timestamp_ntz'1998-01-01'").drop("o_custkey")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice") * 0.8)
    status = F.when(F.col("o_orderkey") % 6 == 0, "X").when(F.col("o_orderstatus") == "F", "P").otherwise(F.col("o_orderstatus"))
    after = o.where("o_orderdate >= timestamp_ntz'1998-01-01'").select(
        F.col("o_orderkey").alias("O_ORDERKEY"), price.alias("o_totalprice"), status.alias("o_orderstatus"), "o_orderdate", "o_orderpriority",
        (F.col("o_totalprice") * 0.1).alias("rebate"))
    return before, after


@query
def aligned_columns(spark, folder):
    before, after = _halves(spark, folder)
    return cp.aligned_columns(pr.profile(before, "sketch"), pr.profile(after, "sketch"))


@query
def shape_changes(spark, folder):
    a, b = (pr.profile_table(x, "sketch") for x in _halves(spark, folder))
    return tidy(cp.shape_changes(a, b, spark))


@query
def measure_changes(spark, folder):
    a, b = _halves(spark, folder)
    return tidy(cp.measure_changes(a, b, {"o_totalprice": "o_totalprice", "o_orderkey": "O_ORDERKEY"}, a.count(), b.count()))


@query
def category_shares(spark, folder):
    return tidy(cp.category_shares(*_halves(spark, folder), {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}))


@query
def category_changes(spark, folder):
    return tidy(cp.category_changes(*_halves(spark, folder), {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}))


@query
def quality_change(spark, folder):
    clean, messy = load(spark, folder, "customer"), messy_customers(spark, folder)
    return tidy(cp.quality_change(qu.health(clean)[1], qu.health(messy)[1]), 1)


@query
def compare(spark, folder):
    return tidy(cp.compare(*_halves(spark, folder)))


@query
def comparable(spark, folder):
    return tidy(cp.comparable(*_halves(spark, folder)))


@query
def simulate_direct(spark, folder):
    return tidy(wi.simulate(load(spark, folder, "lineitem"), "l_extendedprice", 500.0), 2)


@query
def simulate_driver(spark, folder):
    return tidy(wi.simulate(load(spark, folder, "part"), "p_retailprice", 20.0, "p_partkey"), 2)


@query
def drivers(spark, folder):
    return tidy(wi.drivers(load(spark, folder, "part"), "p_retailprice"), 6)


# ---------------------------------------------------------------- chart data --
@query
def line_data(spark, folder):
    return tidy(ch.line_data(load(spark, folder, "orders"), "o_orderdate", "o_totalprice", "max", "W"))


@query
def bar_data(spark, folder):
    return tidy(ch.bar_data(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "mean", 20, True))


@query
def scatter_fit(spark, folder):
    return tidy(ch.scatter_fit(load(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


@query
def scatter_points(spark, folder):
    return tidy(ch.scatter_data(messy_customers(spark, folder), "age", "gappy", ["customer_ref"]))


@query
def histogram(spark, folder):
    return tidy(ch.histogram(load(spark, folder, "lineitem"), "l_extendedprice"))


@query
def box_stats(spark, folder):
    return tidy(ch.box_stats(load(spark, folder, "lineitem"), "l_discount", "l_extendedprice", 8))


@query
def heatmap_data(spark, folder):
    return ch.heatmap_data(load(spark, folder, "lineitem"), MEASURES)


@query
def map_points(spark, folder):
    return tidy(ge.map_points(placed_customers(spark, folder), "latitude", "longitude", "reading", ["c_custkey"]))


@query
def map_view(spark, folder):
    return tidy(ge.map_view(placed_customers(spark, folder), "latitude", "longitude", "reading"))


@query
def densest_cell(spark, folder):
    return tidy(ge.densest_cell(placed_customers(spark, folder), "latitude", "longitude", "reading"))


@query
def geo_stats(spark, folder):
    return tidy(ge.geo_stats(placed_customers(spark, folder), "latitude", "longitude", "reading"))


@query
def chart_candidates(spark, folder):
    return tidy(ch.chart_candidates(story_orders(spark, folder)))


@query
def world_time_series(spark, folder):
    df = load(spark, folder, "orders")
    bundle = al.timeseries_bundle(df, ro.Routing("timeseries", "o_orderdate", "o_orderstatus", "o_totalprice"), "M", 3)
    return tidy(bundle.tables["series"])


@query
def world_geo(spark, folder):
    return tidy(al.world(placed_customers(spark, folder)).tables["stats"])


@query
def world_tabular(spark, folder):
    return tidy(al.world(load(spark, folder, "part")).tables["distribution"])


# ----------------------------------------------------------------- text jobs --
@query
def number_tokens(spark, folder):
    stated = tx.number_tokens(load(spark, folder, "documents"), "text", ["doc_id"])
    return stated.groupBy("doc_id").agg(F.count("*").alias("n_numbers"), F.max("number").alias("largest"))


@query
def grounding_audit(spark, folder):
    """Which documents state numbers that no benchmark passage states."""
    allowed = tx.number_tokens(load(spark, folder, "benchmark"), "text", ["item_id"]).select("number").unionByName(
        load(spark, folder, "part").select(F.col("p_retailprice").alias("number")))
    return tidy(tx.grounding_audit(load(spark, folder, "documents"), "text", ["doc_id"], allowed))


@query
def grounding_with_repeated_keys(spark, folder):
    """The same documents, keyed by a language that repeats and is null in places."""
    allowed = load(spark, folder, "part").select(F.col("p_retailprice").alias("number"))
    texts = load(spark, folder, "documents").select(F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), "text")
    return tidy(tx.grounding_audit(texts, "text", ["lang"], allowed))


@query
def tag_intent(spark, folder):
    return tidy(tx.tag_intent(load(spark, folder, "conversations"), "text", ["conv_id", "turn"]))


@query
def intents_of_documents(spark, folder):
    return tidy(tx.tag_intent(load(spark, folder, "documents"), "text", ["doc_id"]).groupBy("intent").agg(F.count("*").alias("n")))


@query
def mentioned_columns(spark, folder):
    found = tx.mentioned_columns(load(spark, folder, "documents"), "text", ["doc_id"], ["text", "lang", "source", "the", "time", "part", "order", "user_id"])
    return tidy(found.select("doc_id", F.concat_ws("|", "mentioned").alias("mentioned")))
