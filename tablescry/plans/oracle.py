"""The SQL twin of each registered query, for an independent engine to run."""

from __future__ import annotations

from tablescry.functions.names import is_identifier
from tablescry.functions.scalars import MISSING_WORDS, WHITE_SPACE
from tablescry.operators.quality import GRADES, PENALTY_CEILING
from tablescry.operators.textjobs import INTENTS
from tablescry.plans.derived import MESSY_SQL, PLACED_SQL, SPARSE_SQL, STORY_SQL, WRITTEN_SQL
from tablescry.plans.registered import CITY_SPELLINGS, MEASURES

ORACLES: dict[str, str] = {}

WORDS = ", ".join(f"'{w}'" for w in MISSING_WORDS)
SPACES = " || ".join(f"chr({ord(ch)})" for ch in WHITE_SPACE)
NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def strip(c: str) -> str:
    return f"trim({c}, {SPACES})"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {NUMBER}) THEN TRY_CAST({c} AS DOUBLE) END"


# ------------------------------------------------------------ sources, sinks --
ORACLES["csv_with_line_breaks"] = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || 'said "no", twice' || chr(10) || c_mktsegment
  WHEN 1 THEN chr(10) || ',' || c_name ELSE c_mktsegment || ' ' END AS note, round(c_acctbal, 4) AS c_acctbal FROM customer"""
ORACLES["csv_round_trip"] = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer"
ORACLES["infer_column_types"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority FROM orders"""
ORACLES["preview_rows"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority,
  (SELECT count(*) FROM orders) AS total_rows, (SELECT count(*) > 200 FROM orders) AS truncated
FROM orders ORDER BY o_orderkey LIMIT 200"""
ORACLES["json_records"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
ORACLES["kept_original"] = f"""WITH {MESSY_SQL}
SELECT 'original' AS version, count(*) AS n, round(sum(age), 4) AS total FROM messy
UNION ALL SELECT 'current', count(*), round(sum(age), 4) FROM messy WHERE NOT (age < 0 OR age > 130)"""

# ------------------------------------------------------- coercion, text rules --
ORACLES["parse_mixed_dates"] = f"WITH {WRITTEN_SQL} SELECT o_orderkey, day FROM read"
ORACLES["undecorated_numbers"] = f"""WITH {MESSY_SQL}
SELECT customer_ref, 'Rs ' AS prefix, round(TRY_CAST(replace(substr(spend, 4), ',', '') AS DOUBLE), 4) AS number FROM messy"""
ORACLES["missing_words"] = f"""WITH {MESSY_SQL}
SELECT segment, count(*) FILTER (lower({strip('segment')}) IN ({WORDS})) AS n_missing_words FROM messy GROUP BY segment"""
ORACLES["spelling_keys"] = f"""WITH {MESSY_SQL}
SELECT regexp_replace(lower({strip('city')}), '[^a-z0-9]', '', 'g') AS spelling_key, count(DISTINCT city) AS n_spellings, count(*) AS n
FROM messy GROUP BY 1"""
ORACLES["yearly_percent_change"] = """
SELECT o_orderstatus, round((b - a) / abs(a) * 100, 4) AS pct_change FROM (
  SELECT o_orderstatus, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS b
  FROM orders GROUP BY 1)"""


# --------------------------------------------------------- profile and roles --
def category_rule(n_unique: str, n: str) -> str:
    return f"({n_unique} BETWEEN 1 AND 20 AND ({n} < 200 OR {n_unique} / {n}::DOUBLE < 0.05))"


def profile_sql(table: str, columns: list[tuple[str, str]], prefix: str = "") -> str:
    """UNION of one row per column; kinds are n(umber), d(ate), t(ext)."""
    parts = []
    for name, kind in columns:
        if kind == "d":
            meaning, low, high, mean = "'datetime'", "NULL", "NULL", "NULL"
            dates = f"strftime(min({name}), '%Y-%m-%dT%H:%M:%S'), strftime(max({name}), '%Y-%m-%dT%H:%M:%S')"
            if table == "events":
                dates = f"strftime(min({name}), '%Y-%m-%dT%H:%M:%S.%f'), strftime(max({name}), '%Y-%m-%dT%H:%M:%S.%f')"
        else:
            fallback = "numeric" if kind == "n" else "text"
            rule = category_rule(f"count(DISTINCT {name})", "count(*)")
            meaning = f"CASE WHEN {rule} THEN 'categorical' ELSE '{fallback}' END"
            stat = "CASE WHEN NOT " + rule + " THEN round({f}({c})::DOUBLE, 4) END"
            low, high, mean = [stat.format(f=f, c=name) if kind == "n" else "NULL" for f in ("min", "max", "avg")]
            dates = "NULL, NULL"
        parts.append(
            f"SELECT '{name}', {meaning}, count(*) - count({name}), round(100.0 * (count(*) - count({name})) / count(*), 2), "
            f"count(DISTINCT {name}), {low}, {high}, {mean}, {dates} FROM {table}"
        )
    names = '"column", semantic_type, n_null, null_pct, n_unique, "min", "max", mean, min_date, max_date'
    body = " UNION ALL ".join(parts)
    return (
        f'{prefix} SELECT "column", semantic_type, n_null, null_pct::DOUBLE AS null_pct, n_unique, "min"::DOUBLE AS "min", '
        f'"max"::DOUBLE AS "max", mean::DOUBLE AS mean, min_date::VARCHAR AS min_date, max_date::VARCHAR AS max_date FROM ({body}) AS p({names})'
    )


CUSTOMER = [("c_custkey", "n"), ("c_name", "t"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "t")]
LINEITEM = [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"),
            ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "t"), ("l_linestatus", "t"), ("l_shipdate", "d")]
EVENTS = [("event_id", "n"), ("ts", "d"), ("user_id", "n"), ("event_type", "t"), ("value", "n"), ("props", "t")]
DOCUMENTS = [("doc_id", "n"), ("text", "t"), ("lang", "t"), ("source", "t"), ("n_chars", "n")]
ORDERS = [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "t"), ("o_totalprice", "n"), ("o_orderdate", "d"), ("o_orderpriority", "t")]
PART = [("p_partkey", "n"), ("p_name", "t"), ("p_brand", "t"), ("p_type", "t"), ("p_size", "n"), ("p_retailprice", "n")]

ORACLES["profile_customer"] = profile_sql("customer", CUSTOMER)
ORACLES["profile_lineitem"] = profile_sql("lineitem", LINEITEM)
ORACLES["profile_events"] = profile_sql("events", EVENTS)
ORACLES["profile_documents"] = profile_sql("documents", DOCUMENTS)
ORACLES["profile_flags"] = f"""
SELECT (SELECT count(*) FROM lineitem) AS n_rows, count(*) AS n_cols, bool_or(semantic_type = 'datetime') AS has_datetime,
  false AS has_geo, count(*) FILTER (semantic_type = 'numeric') AS n_numeric FROM ({profile_sql('lineitem', LINEITEM)})"""
ORACLES["column_kinds"] = f"SELECT semantic_type, count(*) AS n_columns FROM ({profile_sql('lineitem', LINEITEM)}) GROUP BY 1"
ORACLES["top_values"] = """
SELECT "column", position, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM (
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)) WHERE position <= 10"""
TOP3 = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM part GROUP BY 2" for c, _ in PART
)
ORACLES["compact_profile"] = f"""
WITH p AS ({profile_sql('part', PART)}), v AS ({TOP3}),
top AS (SELECT "column", string_agg(value, '|' ORDER BY n DESC, value) AS examples FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS i FROM v) WHERE i <= 3 GROUP BY 1)
SELECT p."column", semantic_type, n_unique, null_pct, CASE WHEN semantic_type = 'categorical' THEN examples ELSE '' END AS examples
FROM p LEFT JOIN top ON p."column" = top."column" """
ORACLES["value_count_table"] = """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"""


def route_sql(table: str, columns: list[tuple[str, str]], time: str | None) -> str:
    ids = [c for c, _ in columns if is_identifier(c)]
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _) in enumerate(columns))
    barred = ", ".join(f"'{c}'" for c in ids) or "''"
    return f"""
WITH p AS (SELECT *, CASE "column" {order} END AS i FROM ({profile_sql(table, columns)}))
SELECT CASE WHEN bool_or(semantic_type = 'datetime') AND count(*) FILTER (semantic_type = 'numeric') > 0 THEN 'timeseries' ELSE 'tabular' END AS archetype,
  {f"'{time}'" if time else 'NULL::VARCHAR'} AS time_col,
  arg_min("column", i) FILTER (semantic_type = 'categorical') AS entity_col,
  arg_min("column", i + CASE WHEN "column" IN ({barred}) THEN 1000 ELSE 0 END) FILTER (semantic_type = 'numeric') AS target_col,
  NULL::VARCHAR AS lat_col, NULL::VARCHAR AS lon_col FROM p"""


ORACLES["route_time_series"] = route_sql("orders", ORDERS, "o_orderdate")
ORACLES["route_tabular"] = route_sql("part", PART, None)
ORACLES["route_geo"] = f"""WITH {PLACED_SQL}
SELECT 'geo' AS archetype, NULL::VARCHAR AS time_col, 'sensor_type' AS entity_col, 'c_custkey' AS target_col, 'latitude' AS lat_col, 'longitude' AS lon_col
FROM placed HAVING min(latitude) >= -90 AND max(latitude) <= 90 AND min(longitude) >= -180 AND max(longitude) <= 180"""
ORACLES["measure_ranking"] = """
SELECT row_number() OVER (ORDER BY measure != 'p_partkey', variation DESC) AS position, measure, round(variation, 4) AS variation FROM (
  SELECT 'p_partkey' AS measure, stddev_samp(p_partkey) / abs(avg(p_partkey)) AS variation FROM part
  UNION ALL SELECT 'p_size', stddev_samp(p_size) / abs(avg(p_size)) FROM part
  UNION ALL SELECT 'p_retailprice', stddev_samp(p_retailprice) / abs(avg(p_retailprice)) FROM part)"""


def spread_sql(column: str) -> str:
    return f"""SELECT '{column}' AS category, count(*) AS n_groups, stddev_samp(m) / (SELECT abs(avg(l_extendedprice)) FROM lineitem) AS spread
  FROM (SELECT {column}, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)"""


ORACLES["category_spread"] = "SELECT category, n_groups, round(spread, 6) AS spread FROM (" + " UNION ALL ".join(
    spread_sql(c) for c in ("l_returnflag", "l_linestatus", "l_discount")) + ")"


def pairs_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({b}, {a}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {table}"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    )


PART_MEASURES = ["p_partkey", "p_size", "p_retailprice"]
ORACLES["best_pair"] = f"""SELECT a, b, round(r, 6) AS r, n FROM ({pairs_sql('part', PART_MEASURES)})
WHERE abs(r) <= 0.995 ORDER BY abs(r) DESC, a, b LIMIT 1"""

# ----------------------------------------------------- summaries and filters --
ORACLES["aggregate_total"] = "SELECT round(sum(l_extendedprice), 2) AS value, count(*) AS rows_used, 0::BIGINT AS rows_excluded FROM lineitem"
ORACLES["aggregate_median"] = f"""WITH {MESSY_SQL}
SELECT round(median(gappy), 4) AS value, count(gappy) AS rows_used, count(*) - count(gappy) AS rows_excluded FROM messy"""
ORACLES["rank_groups"] = """
SELECT l_returnflag AS "group", round(sum(l_extendedprice), 2) AS value, count(*) AS "rows", count(*) OVER () AS n_groups
FROM lineitem GROUP BY 1 ORDER BY value DESC LIMIT 10"""
ORACLES["rank_groups_by_median"] = """
SELECT "group", round(value, 4) AS value, "rows", n_groups FROM (
  SELECT l_suppkey::VARCHAR AS "group", median(l_extendedprice) AS value, count(*) AS "rows", count(*) OVER () AS n_groups FROM lineitem GROUP BY 1)
ORDER BY value, "group" LIMIT 25"""
ORACLES["count_where"] = f"""WITH {MESSY_SQL}
SELECT count(*) FILTER (lower({strip('city')}) = 'port alba') AS matching_rows, count(*) AS total_rows,
  round(100.0::DOUBLE * count(*) FILTER (lower({strip('city')}) = 'port alba') / count(*), 2) AS share_pct FROM messy"""
ORACLES["usable_rows"] = f"""WITH {WRITTEN_SQL}
SELECT count(*) AS n_rows, count(day) AS n_used, count(*) - count(day) AS n_bad_when, 0::BIGINT AS n_bad_price FROM read"""
ORACLES["time_range_filter"] = """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1"""
ORACLES["top_value_filter"] = "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 2"
ORACLES["out_of_range"] = f"WITH {MESSY_SQL} SELECT age, count(*) AS n FROM messy WHERE age < 0 OR age > 130 GROUP BY 1"
ORACLES["describe_number"] = """
SELECT round(min(l_extendedprice), 4) AS lowest, round(max(l_extendedprice), 4) AS highest, round(avg(l_extendedprice), 4) AS average,
  0::BIGINT AS missing_rows, 0.0::DOUBLE AS missing_pct, count(DISTINCT l_extendedprice) AS distinct_values,
  round(median(l_extendedprice), 4) AS typical FROM lineitem"""
ORACLES["describe_category"] = f"""WITH {MESSY_SQL}
SELECT segment AS value, count(*) AS n, (SELECT count(DISTINCT segment) FROM messy) AS distinct_values,
  (SELECT count(*) FROM messy WHERE segment IS NULL) AS missing_rows,
  (SELECT round(100.0::DOUBLE * count(*) FILTER (segment IS NULL) / count(*), 2) FROM messy) AS missing_pct
FROM messy WHERE segment IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5"""
ORACLES["summary_stats"] = """
SELECT count(*) AS "count", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS "min", round(max(v), 4) AS "max",
  round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75
FROM (SELECT l_extendedprice AS v FROM lineitem)"""
ORACLES["category_counts"] = """
SELECT p_brand AS value, count(*) AS n, (SELECT count(DISTINCT p_brand) FROM part) AS n_categories FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 15"""
ORACLES["quantiles"] = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, {p}::DOUBLE AS p, round(quantile_cont({m}, {p}), 4) AS q FROM lineitem" for m in MEASURES for p in (0.1, 0.25, 0.5, 0.75, 0.9))
ORACLES["quantiles_of_large_groups"] = " UNION ALL ".join(
    f"""SELECT "line.status", {p}::DOUBLE AS p, round(quantile_cont(v, {p}), 4) AS q FROM (
  SELECT nullif(l_linestatus, 'O') AS "line.status", unnest([{", ".join(f"{m}::DOUBLE" for m in MEASURES)}]) AS v FROM lineitem) GROUP BY 1""" for p in (0.01, 0.5, 0.999))
ORACLES["distinct_days"] = "SELECT count(DISTINCT l_shipdate::DATE) AS n_days FROM lineitem"
ORACLES["overview"] = f"""
WITH p AS ({profile_sql('orders', ORDERS)}), r AS ({ORACLES['route_time_series']})
SELECT (SELECT count(*) FROM orders) AS n_rows, count(*) AS n_cols, count(*) FILTER (semantic_type = 'datetime') AS n_datetime,
  count(*) FILTER (semantic_type = 'numeric') AS n_numeric, count(*) FILTER (semantic_type = 'categorical') AS n_categorical, 0::BIGINT AS n_geo,
  count(*) FILTER (semantic_type = 'text') AS n_text, max(min_date[1:10] || ' to ' || max_date[1:10]) AS covers,
  (SELECT target_col FROM r) AS main_measure, (SELECT entity_col FROM r) AS grouped_by, (SELECT archetype FROM r) AS shaped_as FROM p"""
ORACLES["kpis"] = """
WITH s AS (SELECT count(*) AS n, stddev_samp(p_size) / avg(p_size) > stddev_samp(p_retailprice) / avg(p_retailprice) AS size_first,
  avg(p_partkey) AS a0, min(p_partkey)::DOUBLE AS l0, max(p_partkey)::DOUBLE AS h0,
  avg(p_size) AS a1, min(p_size)::DOUBLE AS l1, max(p_size)::DOUBLE AS h1,
  avg(p_retailprice) AS a2, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part)
SELECT 1::BIGINT AS position, 'Rows' AS label, NULL::VARCHAR AS "column", n::DOUBLE AS value, NULL::DOUBLE AS lowest, NULL::DOUBLE AS highest, 'shape' AS kind,
  NULL::VARCHAR AS most_common, NULL::BIGINT AS most_common_rows FROM s
UNION ALL SELECT 2, 'Columns', NULL, 6.0, NULL, NULL, 'shape', NULL, NULL FROM s
UNION ALL SELECT 3, 'Average', 'p_partkey', round(a0, 2), l0, h0, 'measure', NULL, NULL FROM s
UNION ALL SELECT 4, 'Average', CASE WHEN size_first THEN 'p_size' ELSE 'p_retailprice' END, round(CASE WHEN size_first THEN a1 ELSE a2 END, 2),
  CASE WHEN size_first THEN l1 ELSE l2 END, CASE WHEN size_first THEN h1 ELSE h2 END, 'measure', NULL, NULL FROM s"""
ORACLES["kpis_of_categories"] = """
SELECT 1::BIGINT AS position, 'Rows' AS label, NULL::VARCHAR AS "column", count(*)::DOUBLE AS value, NULL::DOUBLE AS lowest, NULL::DOUBLE AS highest, 'shape' AS kind,
  NULL::VARCHAR AS most_common, NULL::BIGINT AS most_common_rows FROM part
UNION ALL SELECT 2, 'Columns', NULL, 2.0, NULL, NULL, 'shape', NULL, NULL
UNION ALL SELECT 3, 'Distinct', 'p_type', (SELECT count(DISTINCT p_type) FROM part)::DOUBLE, NULL, NULL, 'category', v, n FROM (
  SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"""


def segment_sql(table: str, column: str, target: str) -> str:
    return f"""SELECT '{column}' AS category, '{target}' AS measure, arg_max(g, m) AS best_group, max(m) AS best_average, arg_max(n, m) AS best_rows,
  arg_min(g, m) AS worst_group, min(m) AS worst_average, arg_min(n, m) AS worst_rows, (SELECT avg({target}) FROM {table}) AS overall_average,
  count(*) AS n_groups FROM (SELECT {column} AS g, avg({target}) AS m, count({target}) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count({target}) >= 3)"""


ORACLES["segments"] = f"""
SELECT category, measure, best_group, round(best_average, 4) AS best_average, best_rows, worst_group, round(worst_average, 4) AS worst_average, worst_rows,
  round(overall_average, 4) AS overall_average, n_groups, round(100 * (best_average - overall_average) / abs(overall_average), 4) AS gap_pct
FROM ({segment_sql('orders', 'o_orderstatus', 'o_totalprice')} UNION ALL {segment_sql('orders', 'o_orderpriority', 'o_totalprice')})"""

# ----------------------------------------------------- correlation and fits --
LINE_PAIRS = pairs_sql("lineitem", MEASURES)
ORACLES["correlation_matrix"] = f"""
WITH p AS ({LINE_PAIRS}) SELECT a, b, round(r, 6) AS r, n FROM (SELECT a, b, r, n FROM p UNION ALL SELECT b, a, r, n FROM p
  UNION ALL {" UNION ALL ".join(f"SELECT '{m}', '{m}', 1.0, count({m}) FROM lineitem" for m in MEASURES)})"""
ORACLES["correlation_with_gaps"] = f"""WITH {MESSY_SQL}, g AS (SELECT gappy, age, balance, CASE WHEN customer_ref % 3 > 0 THEN customer_ref END AS ref FROM messy)
SELECT a, b, round(r, 6) AS r, n FROM ({pairs_sql('g', ['gappy', 'age', 'balance', 'ref'])})"""
BAND = "CASE WHEN abs(r) >= 0.75 THEN 'very close' WHEN abs(r) >= 0.5 THEN 'clear' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'none' END"
ORACLES["relationship"] = f"""SELECT a, b, round(r, 6) AS r, n, CASE WHEN r > 0 THEN 'same direction' ELSE 'opposite directions' END AS direction, {BAND} AS strength
FROM ({pairs_sql('part', ['p_partkey', 'p_retailprice'])})"""
ORACLES["relationships"] = f"""SELECT a, b, round(r, 6) AS r, n, {BAND} AS strength, count(*) OVER () AS n_pairs
FROM ({pairs_sql('part', PART_MEASURES)}) WHERE abs(r) >= 0.001 ORDER BY abs(r) DESC LIMIT 3"""
ORACLES["linear_fit"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  count(*) AS n, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem"""

# --------------------------------------------------------------- time series --
ORACLES["suggest_frequency"] = """
SELECT source, span_days, CASE WHEN span_days <= 90 THEN 'D' WHEN span_days <= 800 THEN 'W' ELSE 'M' END AS freq FROM (
  SELECT 'orders' AS source, datesub('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders
  UNION ALL SELECT 'events', datesub('day', min(ts), max(ts)) FROM events)"""


def period(c: str, freq: str) -> str:
    return {"D": f"{c}::DATE", "W": f"(date_trunc('week', {c}::DATE) + INTERVAL 6 DAY)::DATE", "M": f"last_day({c}::DATE)"}[freq]


def resample_sql(table: str, time: str, value: str, freq: str, agg: str, zero: bool = False) -> str:
    """(period, value) with a full calendar between the first and the last period."""
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}[freq]
    start = "date_trunc('month', min(period))" if freq == "M" else "min(period)"
    label = "last_day(d::DATE)" if freq == "M" else "d::DATE"
    filled = "coalesce(o.value, 0)" if zero else "o.value"
    return f"""(WITH o AS (SELECT {period(time, freq)} AS period, {agg}({value})::DOUBLE AS value FROM {table} WHERE {value} IS NOT NULL AND {time} IS NOT NULL GROUP BY 1),
  grid AS (SELECT {label} AS period FROM (SELECT unnest(generate_series({start}::TIMESTAMP, max(period)::TIMESTAMP, {step})) AS d FROM o))
  SELECT grid.period, {filled} AS value FROM grid LEFT JOIN o ON grid.period = o.period)"""


ORACLES["resample_daily_mean"] = f"WITH {SPARSE_SQL} SELECT period, round(value, 4) AS value FROM {resample_sql('sparse', 'ts', 'value', 'D', 'avg')}"
ORACLES["resample_weekly_sum"] = f"SELECT period, round(value, 2) AS value FROM {resample_sql('orders', 'o_orderdate', 'o_totalprice', 'W', 'sum', True)}"
ORACLES["resample_monthly_median"] = f"SELECT period, round(value, 4) AS value FROM {resample_sql('lineitem', 'l_shipdate', 'l_extendedprice', 'M', 'median')}"
ORACLES["resample_daily_count"] = f"WITH {SPARSE_SQL} SELECT period, round(value, 4) AS value FROM {resample_sql('sparse', 'ts', 'value', 'D', 'count', True)}"
ORACLES["rolling_mean"] = f"""WITH {SPARSE_SQL} SELECT period, round(value, 4) AS value,
  round(avg(value) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_mean
FROM {resample_sql('sparse', 'ts', 'value', 'D', 'avg')}"""
ORACLES["resample_by_entity"] = f"""
WITH top AS (SELECT l_discount FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_discount::VARCHAR LIMIT 6)
SELECT l_discount::VARCHAR AS entity, {period('l_shipdate', 'M')} AS period, round(avg(l_extendedprice), 6) AS value, count(*) AS "rows"
FROM lineitem WHERE l_discount IN (SELECT l_discount FROM top) GROUP BY 1, 2"""
ORDER_MONTHS = resample_sql("orders", "o_orderdate", "o_totalprice", "M", "avg")
RANKED_MONTHS = f"SELECT period, value, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM {ORDER_MONTHS} WHERE value IS NOT NULL"
ORACLES["trend_slope"] = f"""
SELECT CASE WHEN abs(slope * (n - 1)) < 0.05 * scale THEN 'flat' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction,
  round(slope, 4) AS slope, n AS n_periods FROM (
  SELECT regr_slope(value, i) AS slope, count(*) AS n, abs(avg(value)) AS scale FROM ({RANKED_MONTHS}))"""


def thirds_sql(ranked: str) -> str:
    return f"""SELECT count(*) AS n_periods, avg(value) FILTER (i < greatest(n // 3, 1)) AS start_average,
  avg(value) FILTER (i >= n - greatest(n // 3, 1)) AS end_average, arg_max(period, value) AS peak_period, max(value) AS peak_value,
  arg_min(period, value) AS low_period, min(value) AS low_value, min(period) AS first_period, max(period) AS last_period FROM ({ranked})"""


THIRDS = """n_periods, round(start_average, 4) AS start_average, round(end_average, 4) AS end_average, peak_period, round(peak_value, 4) AS peak_value,
  low_period, round(low_value, 4) AS low_value, first_period, last_period,
  round(100 * (end_average - start_average) / abs(start_average), 4) AS change_pct,
  CASE WHEN end_average > start_average THEN 'up' WHEN end_average < start_average THEN 'down' ELSE 'flat' END AS direction"""
ORACLES["trend_thirds"] = f"SELECT {THIRDS} FROM ({thirds_sql(RANKED_MONTHS)})"
ORACLES["trends"] = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, {THIRDS}, 'M' AS freq FROM ({thirds_sql(RANKED_MONTHS.replace('o_totalprice', m))})" for m in ("o_totalprice", "o_custkey"))
ORACLES["series_stats"] = f"""WITH {SPARSE_SQL} SELECT round(avg(value), 4) AS mean, round(min(value), 4) AS "min", round(max(value), 4) AS "max",
  round(stddev_samp(value), 4) AS std, min(period) AS first_period, max(period) AS last_period, count(*) AS n_periods, count(value) AS n_observed
FROM {resample_sql('sparse', 'ts', 'value', 'D', 'avg')}"""
ORACLES["forecast_by_type"] = f"""WITH {SPARSE_SQL},
d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM sparse GROUP BY ALL),
calendar AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1),
s AS (SELECT event_type, day, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day) AS y, v IS NULL AS filled FROM calendar LEFT JOIN d USING (event_type, day)),
p AS (SELECT event_type, count(*) AS n_periods, count(*) FILTER (filled) AS n_filled FROM s WHERE y IS NOT NULL GROUP BY 1),
f AS (SELECT event_type, day, y, lag(y) OVER (PARTITION BY event_type ORDER BY day) AS l1, lag(y, 7) OVER (PARTITION BY event_type ORDER BY day) AS l7 FROM s WHERE y IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) > floor(0.8 * count(*) OVER (PARTITION BY event_type)) AS test FROM f WHERE l7 IS NOT NULL),
m AS (SELECT event_type, round(avg(abs(y - l1)) FILTER (test), 4) AS baseline_mae, count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test
  FROM r GROUP BY 1 HAVING count(*) >= 30)
SELECT event_type, CASE WHEN n_test IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status, baseline_mae, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test,
  n_periods, n_filled, n_filled / n_periods::DOUBLE > 0.3 AS heavily_filled, CASE WHEN n_test IS NOT NULL THEN 7 END::BIGINT AS n_projected, CASE WHEN n_test IS NOT NULL THEN true END AS in_range
FROM p LEFT JOIN m USING (event_type)"""
ORACLES["forecast_readiness"] = """SELECT count(DISTINCT o_orderdate::DATE) AS days_observed, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day,
  30::BIGINT AS days_needed, count(DISTINCT o_orderdate::DATE) >= 30 AS ready FROM orders"""


def lag_sql(series: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""(SELECT * FROM (SELECT {lead}period, y, filled, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7,
    avg(y) OVER ({part}ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
    (isodow(period) - 1)::BIGINT AS day_of_week, month(period)::BIGINT AS "month"
  FROM (SELECT {lead}period, last_value(value IGNORE NULLS) OVER ({part}ORDER BY period ROWS UNBOUNDED PRECEDING) AS y, value IS NULL AS filled FROM {series})
  WINDOW w AS ({part}ORDER BY period)) WHERE lag_7 IS NOT NULL)"""


ORDER_LAGS = lag_sql(resample_sql("orders", "o_orderdate", "o_totalprice", "D", "avg"))
ORACLES["lag_features"] = f"""SELECT period, round(y, 6) AS y, filled, round(lag_1, 6) AS lag_1, round(lag_7, 6) AS lag_7,
  round(rolling_mean_7, 6) AS rolling_mean_7, day_of_week, "month" FROM {ORDER_LAGS}"""
TYPE_DAYS = """(WITH o AS (SELECT event_type, ts::DATE AS period, avg(value) AS value FROM sparse WHERE value IS NOT NULL GROUP BY 1, 2),
  grid AS (SELECT event_type, unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS period FROM o GROUP BY 1)
  SELECT grid.event_type, grid.period, o.value FROM grid LEFT JOIN o ON grid.period = o.period AND grid.event_type = o.event_type)"""
ORACLES["lag_features_by_type"] = f"""WITH {SPARSE_SQL} SELECT event_type, period, round(y, 6) AS y, filled, round(lag_1, 6) AS lag_1, round(lag_7, 6) AS lag_7,
  round(rolling_mean_7, 6) AS rolling_mean_7, day_of_week, "month" FROM {lag_sql(TYPE_DAYS, 'event_type')}"""
SPLIT = f"(SELECT *, row_number() OVER (ORDER BY period) <= floor(count(*) OVER () * 0.8) AS is_train FROM {ORDER_LAGS})"
ORACLES["chronological_split"] = f"SELECT is_train, count(*) AS n, min(period) AS first_day, max(period) AS last_day FROM {SPLIT} GROUP BY 1"
ORACLES["naive_baseline"] = f"""SELECT round(avg(abs(y - lag_1)) FILTER (NOT is_train), 2) AS baseline_mae, count(*) FILTER (is_train) AS n_train,
  count(*) FILTER (NOT is_train) AS n_test FROM {SPLIT}"""

# ------------------------------------------------------------- quality audit --
N_COLS = 11
CEILINGS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTY_CEILING.items())
FIXES = """CASE kind WHEN 'duplicate_rows' THEN 'drop_duplicates' WHEN 'duplicate_columns' THEN 'drop_column' WHEN 'empty_column' THEN 'drop_column'
  WHEN 'constant_column' THEN 'drop_column' WHEN 'missing_values' THEN 'fill_missing' WHEN 'numeric_as_text' THEN 'to_numeric'
  WHEN 'whitespace' THEN 'trim_whitespace' WHEN 'category_variants' THEN 'merge_categories' WHEN 'impossible_values' THEN 'drop_invalid'
  WHEN 'outliers' THEN 'cap_outliers' END"""
TEXTS = ("city", "spend", "segment", "notes", "region_code", "label")
ALL_COLUMNS = ("customer_ref", "city", "spend", "age", "segment", "notes", "region_code", "balance", "balance_again", "label", "gappy")


def issues_sql(raw: str) -> str:
    """Finish rows of (kind, col, n, severity) with percent, id, fix and penalty."""
    return f"""
SELECT kind || ':' || coalesce(col, '') AS id, kind, severity, n AS n_affected, pct AS pct_affected, {FIXES} AS fix_action,
  round(least(greatest(ceiling * least(1.0, sqrt(pct / 100 * CASE WHEN col IS NULL THEN 1.0 ELSE 1.0 / {N_COLS} END)),
    CASE WHEN severity = 'critical' THEN ceiling * 0.25 ELSE 0 END), ceiling), 2)::DOUBLE AS penalty
FROM (SELECT *, CASE kind {CEILINGS} END::DOUBLE AS ceiling FROM ({raw}))"""


PCT = "round(100.0::DOUBLE * n / (SELECT count(*) FROM messy), 2)"
DUPLICATES = f"""SELECT 'duplicate_rows' AS kind, NULL::VARCHAR AS col, n::BIGINT AS n, {PCT} AS pct, CASE WHEN {PCT} >= 5 THEN 'critical' ELSE 'warning' END AS severity
  FROM (SELECT sum(k - 1) AS n FROM (SELECT count(*) AS k FROM messy GROUP BY ALL HAVING true) g) WHERE n > 0"""
DUPLICATES = DUPLICATES.replace(
    "SELECT count(*) AS k FROM messy GROUP BY ALL HAVING true", f"SELECT count(*) AS k FROM messy GROUP BY {', '.join(ALL_COLUMNS)}")
SAME_COLUMNS = """SELECT 'duplicate_columns' AS kind, 'balance_again' AS col, count(*) AS n, 100.0::DOUBLE AS pct, 'warning' AS severity FROM messy
  HAVING bool_and(balance IS NOT DISTINCT FROM balance_again)"""


def missing_rows() -> str:
    parts = []
    for c in ALL_COLUMNS:
        words = f"OR lower({strip(c)}) IN ({WORDS})" if c in TEXTS else ""
        parts.append(f"SELECT '{c}' AS col, count(*) FILTER ({c} IS NULL {words}) AS n FROM messy")
    union = " UNION ALL ".join(parts)
    return f"""SELECT CASE WHEN pct >= 99.5 THEN 'empty_column' ELSE 'missing_values' END AS kind, col, n, pct,
    CASE WHEN pct >= 20 THEN 'critical' WHEN pct >= 2 THEN 'warning' ELSE 'notice' END AS severity
  FROM (SELECT col, n, {PCT} AS pct FROM ({union}) WHERE n > 0)"""


# "Rs " and "R" are the markers that every spend and every region code share.
NUMERIC_TEXT = f"""SELECT 'numeric_as_text' AS kind, col, n, {PCT} AS pct, 'critical' AS severity FROM (
    SELECT 'spend' AS col, count(TRY_CAST(replace(substr(spend, 4), ',', '') AS DOUBLE)) AS n, count(spend) AS present FROM messy
    UNION ALL SELECT 'region_code', count(TRY_CAST(substr(region_code, 2) AS DOUBLE)), count(region_code) FROM messy) WHERE n >= 0.9 * present"""


def mixed_rows() -> str:
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS k, count({number('b')}) AS m FROM (SELECT {c}, regexp_replace({strip(c)}, '[,\\s]', '', 'g') AS b FROM messy)" for c in TEXTS)
    return f"""SELECT 'mixed_types' AS kind, col, n, {PCT} AS pct, 'warning' AS severity
  FROM (SELECT col, CASE WHEN m < 0.5 * k THEN m ELSE k - m END AS n FROM ({union}) WHERE k >= 10 AND m > 0.02 * k AND m < 0.9 * k)"""


UNTIDY = f"SELECT 'whitespace' AS kind, col, n, {PCT} AS pct, 'warning' AS severity FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) FILTER ({c} != {strip(c)}) AS n FROM messy" for c in TEXTS) + ") WHERE n > 0"


def variants_sql(columns: tuple[str, ...]) -> str:
    union = " UNION ALL ".join(f"SELECT '{c}' AS col, {strip(c)} AS v, count(*) AS n FROM messy WHERE {c} IS NOT NULL GROUP BY 2" for c in columns)
    return f"""SELECT col, key, v, first_value(v) OVER (PARTITION BY col, key ORDER BY n DESC, v) AS canonical, n FROM (
    SELECT *, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS key, count(*) OVER (PARTITION BY col) AS vocabulary FROM ({union}))
    WHERE vocabulary BETWEEN 2 AND 400 AND key != ''"""


VARIANTS = f"""SELECT 'category_variants' AS kind, col, n, {PCT} AS pct, 'warning' AS severity
  FROM (SELECT col, sum(n)::BIGINT AS n FROM ({variants_sql(TEXTS)}) WHERE v != canonical GROUP BY 1)"""
CONSTANTS = f"SELECT 'constant_column' AS kind, col, n, 100.0::DOUBLE AS pct, 'notice' AS severity FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) AS n, count(DISTINCT {c}) AS u FROM messy" for c in ALL_COLUMNS) + ") WHERE u = 1"
IMPOSSIBLE = f"""SELECT 'impossible_values' AS kind, 'age' AS col, n, {PCT} AS pct, 'critical' AS severity
  FROM (SELECT count(*) FILTER (age < 0 OR age > 130) AS n FROM messy) WHERE n > 0"""
MESSY_NUMBERS = ("customer_ref", "age", "balance", "balance_again", "gappy")


def fence_sql(c: str) -> str:
    return f"""SELECT '{c}' AS col, q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high, q2 AS mid, p10, p90,
    (SELECT count(*) FROM messy WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS n
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3,
    quantile_cont({c}, 0.1) AS p10, quantile_cont({c}, 0.9) AS p90, count({c}) AS k FROM messy) WHERE q3 > q1 AND k >= 12"""


OUTLIERS = f"""SELECT 'outliers' AS kind, col, n, {PCT} AS pct, CASE WHEN {PCT} > 1 THEN 'warning' ELSE 'notice' END AS severity
  FROM ({" UNION ALL ".join(fence_sql(c) for c in MESSY_NUMBERS)}) WHERE n > 0"""
RAW_ISSUES = {
    "duplicate_rows": DUPLICATES, "duplicate_columns": SAME_COLUMNS, "missing_values": missing_rows(), "numeric_as_text": NUMERIC_TEXT,
    "mixed_types": mixed_rows(), "whitespace": UNTIDY, "category_variants": VARIANTS, "constant_column": CONSTANTS,
    "impossible_values": IMPOSSIBLE, "outliers": OUTLIERS,
}
for _check, _raw in RAW_ISSUES.items():
    ORACLES[f"audit_{_check}"] = f"WITH {MESSY_SQL} {issues_sql(_raw)}"
ALL_ISSUES = issues_sql(" UNION ALL ".join(f"SELECT kind, col, n, pct, severity FROM ({raw})" for raw in RAW_ISSUES.values()))
ORACLES["health_issues"] = f"WITH {MESSY_SQL} {ALL_ISSUES}"
GRADE = "CASE " + " ".join(f"WHEN score >= {b} THEN '{g}'" for b, g in GRADES) + " ELSE 'Critical' END"
ORACLES["health_score"] = f"""WITH {MESSY_SQL}, i AS ({ALL_ISSUES})
SELECT score, {GRADE} AS grade, n_issues, n_critical, n_warning, n_notice, n_fixable, (SELECT count(*) FROM messy) AS n_rows FROM (
  SELECT round(greatest(0, 100 - sum(penalty)), 1)::DOUBLE AS score, count(*) AS n_issues, count(*) FILTER (severity = 'critical') AS n_critical,
    count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'notice') AS n_notice, count(fix_action) AS n_fixable FROM i)"""
ORACLES["duplicate_row_count"] = f"""WITH {MESSY_SQL}
SELECT (SELECT count(*) FROM messy) AS n_rows, count(*) AS n_distinct, (SELECT count(*) FROM messy) - count(*) AS n_duplicates
FROM (SELECT DISTINCT * FROM messy)"""
ORACLES["spelling_variants"] = f"""WITH {MESSY_SQL}
SELECT col AS "column", key, v AS variant, canonical, n FROM ({variants_sql(('city', 'segment'))}) WHERE v != canonical"""
ORACLES["outlier_fences"] = f"""WITH {MESSY_SQL}
SELECT col AS measure, round(low, 4) AS low, round(high, 4) AS high, round(mid, 4) AS median, n AS n_outside
FROM ({fence_sql('balance')} UNION ALL {fence_sql('age')})"""


def worst_sql(c: str) -> str:
    return f"""SELECT '{c}' AS measure, row_number() OVER (ORDER BY greatest(low - {c}, {c} - high) DESC, customer_ref) AS position, customer_ref, {c}::DOUBLE AS value,
    {c} / nullif(mid, 0) AS ratio, CASE WHEN {c} > high THEN 'above' ELSE 'below' END AS direction
  FROM messy, ({fence_sql(c)}) AS f WHERE {c} < low OR {c} > high"""


ORACLES["worst_outliers"] = f"""WITH {MESSY_SQL} SELECT measure, position, customer_ref, round(value, 4) AS value, round(ratio, 4) AS ratio, direction
FROM ({worst_sql('balance')} UNION ALL {worst_sql('age')}) WHERE position <= 12"""
ORACLES["data_issue_findings"] = f"""WITH {MESSY_SQL}
SELECT 'blanks' AS issue, 'notes' AS subject, 100.0::DOUBLE AS value, (notes >= 20)::BIGINT + (segment >= 20)::BIGINT + (gappy >= 20)::BIGINT AS n, 12.0::DOUBLE AS score,
  list_aggregate(list_transform(list_reverse_sort(list_filter([{{'p': notes, 'c': 'notes'}}, {{'p': segment, 'c': 'segment'}}, {{'p': gappy, 'c': 'gappy'}}], lambda x: x.p >= 20)),
    lambda x: x.c || ' ' || printf('%.2f', x.p)), 'string_agg', ', ') AS columns FROM (
  SELECT round(100.0::DOUBLE * count(*) FILTER (notes IS NULL) / count(*), 2) AS notes, round(100.0::DOUBLE * count(*) FILTER (segment IS NULL) / count(*), 2) AS segment,
    round(100.0::DOUBLE * count(*) FILTER (gappy IS NULL) / count(*), 2) AS gappy FROM messy)
UNION ALL SELECT 'duplicates', NULL, ((SELECT count(*) FROM messy) - count(*))::DOUBLE, (SELECT count(*) FROM messy), 10.0, NULL FROM (SELECT DISTINCT * FROM messy)"""

# ------------------------------------------------------------------ cleaning --
ORACLES["clean_trim_whitespace"] = f"WITH {MESSY_SQL} SELECT {strip('city')} AS city, count(*) AS n FROM messy GROUP BY 1"
MERGED = "CASE " + " ".join(f"WHEN {strip('city')} = '{k}' THEN '{v}'" for k, v in CITY_SPELLINGS.items()) + f" ELSE {strip('city')} END"
ORACLES["clean_merge_categories"] = f"WITH {MESSY_SQL} SELECT {MERGED} AS city, count(*) AS n FROM messy GROUP BY 1"
ORACLES["clean_to_numeric"] = f"WITH {MESSY_SQL} SELECT customer_ref, round(TRY_CAST(replace(substr(spend, 4), ',', '') AS DOUBLE), 4) AS spend FROM messy"
ORACLES["clean_drop_invalid"] = f"WITH {MESSY_SQL} SELECT customer_ref, age FROM messy WHERE NOT coalesce(age < 0 OR age > 130, false)"
ORACLES["clean_cap_outliers"] = f"""WITH {MESSY_SQL}
SELECT customer_ref, round(greatest(least(balance, high), low), 4) AS balance FROM messy, ({fence_sql('balance')}) AS f"""
ORACLES["clean_drop_duplicates"] = f"WITH {MESSY_SQL} SELECT customer_ref, city, age FROM (SELECT DISTINCT * FROM messy)"
ORACLES["clean_drop_column"] = f"""WITH {MESSY_SQL} SELECT customer_ref, city, spend, age, segment, region_code, round(balance, 4) AS balance,
  round(balance_again, 4) AS balance_again, label, round(gappy, 4) AS gappy FROM messy"""
for _name, _fill in (("median", "(SELECT median(gappy) FROM messy)"), ("mean", "(SELECT avg(gappy) FROM messy)"), ("zero", "0.0::DOUBLE")):
    ORACLES[f"clean_fill_{_name}"] = f"WITH {MESSY_SQL} SELECT customer_ref, round(coalesce(gappy, {_fill}), 4) AS gappy FROM messy"
LABELLED = f"CASE WHEN segment IS NULL OR lower({strip('segment')}) IN ({WORDS}) THEN 'Unknown' ELSE segment END"
ORACLES["clean_fill_label"] = f"WITH {MESSY_SQL} SELECT {LABELLED} AS segment, count(*) AS n FROM messy GROUP BY 1"
ORACLES["clean_fill_drop"] = f"WITH {MESSY_SQL} SELECT customer_ref, segment FROM messy WHERE {LABELLED} != 'Unknown'"
ORACLES["clean_fill_forward"] = f"""WITH {SPARSE_SQL} SELECT event_id, round(coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value FROM sparse"""
ORACLES["forward_fill_by_user"] = f"""WITH {SPARSE_SQL} SELECT event_id, user_id, round(coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value FROM sparse"""
ORACLES["forward_fill_of_ties"] = f"""WITH {SPARSE_SQL}, placed AS (SELECT event_id, value, md5(event_id::VARCHAR) AS tie,
  CASE WHEN event_id % 3 != 0 THEN 7.0::DOUBLE WHEN event_id % 10 != 0 THEN (event_id % 20)::DOUBLE END AS day FROM sparse)
SELECT event_id, round(coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY day NULLS FIRST, tie ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (ORDER BY day NULLS FIRST, tie ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value FROM placed"""
PLACE = "CASE fix_action " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate((
    "trim_whitespace", "merge_categories", "to_numeric", "drop_column", "drop_invalid", "cap_outliers", "drop_duplicates", "fill_missing"))) + " END"
ORACLES["clean_plan"] = f"""WITH {MESSY_SQL}, i AS ({ALL_ISSUES})
SELECT row_number() OVER (ORDER BY {PLACE}, split_part(id, ':', 2)) - 1 AS step, fix_action AS action,
  nullif(split_part(id, ':', 2), '') AS "column", id AS issue_id FROM i WHERE fix_action IS NOT NULL"""
RECEIPT = f"""
t AS (SELECT count(*) AS n, count(*) FILTER (city != {strip('city')}) AS trimmed,
    count(*) FILTER ({strip('city')} IN ({", ".join(f"'{k}'" for k in CITY_SPELLINGS)})) AS merged,
    count(TRY_CAST(replace(substr(spend, 4), ',', '') AS DOUBLE)) AS parsed, count(*) FILTER (NOT (age < 0 OR age > 130)) AS valid, count(spend) AS n_spend FROM messy),
d AS (SELECT DISTINCT {MERGED} AS city, * EXCLUDE (city, notes) FROM messy WHERE NOT (age < 0 OR age > 130)),
u AS (SELECT count(*) AS n, count(*) FILTER (gappy IS NULL) AS gaps, count(*) FILTER ({LABELLED} = 'Unknown') AS labelled FROM d),
receipt AS (
  SELECT 0::BIGINT AS step, 'trim_whitespace' AS action, 'city' AS "column", n AS rows_before, n AS rows_after, trimmed AS cells_changed, 0::BIGINT AS cells_lost FROM t
  UNION ALL SELECT 1, 'merge_categories', 'city', n, n, merged, 0 FROM t
  UNION ALL SELECT 2, 'to_numeric', 'spend', n, n, parsed, n_spend - parsed FROM t
  UNION ALL SELECT 3, 'drop_column', 'notes', n, n, n, 0 FROM t
  UNION ALL SELECT 4, 'drop_invalid', 'age', n, valid, 0, 0 FROM t
  UNION ALL SELECT 5, 'drop_duplicates', NULL, t.valid, u.n, 0, 0 FROM t, u
  UNION ALL SELECT 6, 'fill_missing', 'gappy', n, n, gaps, 0 FROM u
  UNION ALL SELECT 7, 'fill_missing', 'segment', n, n, labelled, 0 FROM u)"""
ORACLES["clean_receipt"] = f"WITH {MESSY_SQL}, {RECEIPT} SELECT * FROM receipt"
ORACLES["clean_totals"] = f"""WITH {MESSY_SQL}, {RECEIPT}
SELECT count(*) AS n_steps, sum(rows_before - rows_after)::BIGINT AS rows_removed, sum(cells_changed)::BIGINT AS cells_changed, sum(cells_lost)::BIGINT AS cells_lost FROM receipt"""
ORACLES["clean_receipt_with_losses"] = f"""WITH {MESSY_SQL}, t AS (SELECT count(*) AS n, count(*) FILTER (city != {strip('city')}) AS trimmed,
  count(TRY_CAST(label AS DOUBLE)) AS parsed, count(label) - count(TRY_CAST(label AS DOUBLE)) AS lost FROM messy)
SELECT 0::BIGINT AS step, 'trim_whitespace' AS action, 'city' AS "column", n AS rows_before, n AS rows_after, trimmed AS cells_changed, 0::BIGINT AS cells_lost FROM t
UNION ALL SELECT 1, 'to_numeric', 'label', n, n, parsed, lost FROM t"""

# ------------------------------------------------------- anomalies, findings --
ORACLES["anomalies"] = f"""WITH {MESSY_SQL}, b AS ({fence_sql('balance')}), a AS ({fence_sql('age')}),
odd AS (SELECT count(*) FILTER (balance < b.low OR balance > b.high OR age < a.low OR age > a.high) AS k, count(*) AS n FROM messy, a, b),
x AS (SELECT 'balance' AS measure, customer_ref::VARCHAR AS row_key, balance AS value, abs(balance - mid) AS far, mid, p10, p90, b.n FROM messy, b
  UNION ALL SELECT 'age', customer_ref::VARCHAR, age, abs(age - mid), mid, p10, p90, a.n FROM messy, a)
SELECT k AS n_unusual, round(100.0::DOUBLE * k / odd.n, 4) AS share_pct, odd.n AS rows_scanned, measure, row_key, round(value, 4) AS value,
  round(mid, 4) AS typical, round(p10, 4) AS usual_low, round(p90, 4) AS usual_high, x.n AS n_outside
FROM x, odd WHERE x.n > 0 ORDER BY far DESC LIMIT 1"""
ORACLES["unusual_rows"] = f"""WITH {MESSY_SQL}, b AS ({fence_sql('balance')}), a AS ({fence_sql('age')})
SELECT customer_ref, round(balance, 4) AS balance, age FROM messy, a, b WHERE balance < b.low OR balance > b.high OR age < a.low OR age > a.high"""
ORACLES["outlier_rows"] = """
WITH q AS (SELECT median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.9) AS p90,
  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(l_extendedprice, 4) AS value, round(l_extendedprice - m, 4) AS difference,
  round(m, 4) AS typical, round(p10, 4) AS usual_low, round(p90, 4) AS usual_high,
  (SELECT count(*) FROM lineitem, q WHERE l_extendedprice < q1 - 3 * (q3 - q1) OR l_extendedprice > q3 + 3 * (q3 - q1)) AS n_unusual
FROM lineitem, q ORDER BY abs(l_extendedprice - m) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25"""

STORY_COLUMNS = ("revenue", "cost", "stock_level")


def story_findings() -> str:
    """Every finding of the story table with its score, from the same rules."""
    months = "SELECT period, value, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM {t} WHERE value IS NOT NULL"
    trend_rows = " UNION ALL ".join(
        f"SELECT '{m}' AS subject, * FROM ({thirds_sql(months.format(t=resample_sql('story', 'order_date', m, 'M', 'avg')))})" for m in STORY_COLUMNS)
    change = "100 * (end_average - start_average) / abs(start_average)"
    null = "NULL::VARCHAR"
    trend = f"""SELECT 'trend' AS kind, subject, 'order_date' AS other, CASE WHEN c > 0 THEN 'up' ELSE 'down' END AS direction, c AS value,
      start_average AS baseline, end_average AS comparison, n_periods AS n, least(abs(c), 200) AS score
      FROM (SELECT *, {change} AS c FROM ({trend_rows})) WHERE abs(c) >= 5 AND n_periods >= 6"""
    # the most varied measure comes first in a pair
    ranked = "(SELECT string_agg(m, ',' ORDER BY v DESC) AS names FROM (" + " UNION ALL ".join(
        f"SELECT '{m}' AS m, stddev_samp({m}) / abs(avg({m})) AS v FROM story" for m in STORY_COLUMNS) + "))"
    both = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM story"
        for a in STORY_COLUMNS for b in STORY_COLUMNS if a != b)
    linked = f"""SELECT 'relationship' AS kind, a AS subject, b AS other, CASE WHEN r > 0 THEN 'same direction' ELSE 'opposite directions' END AS direction, r AS value,
      NULL::DOUBLE AS baseline, NULL::DOUBLE AS comparison, n, 60 * abs(r) AS score FROM ({both}), {ranked}
      WHERE abs(r) >= 0.5 AND strpos(names, a) < strpos(names, b)"""
    fence = {m: fence_sql(m).replace("messy", "story") for m in STORY_COLUMNS}
    odd = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, arg_max(struct_pack(value := {m}), abs({m} - mid)) AS x, max(abs({m} - mid)) AS far, any_value(mid) AS mid FROM story, ({fence[m]}) f WHERE f.n > 0"
        for m in STORY_COLUMNS)
    any_odd = " OR ".join(f"coalesce({m} < {m}_f.low OR {m} > {m}_f.high, false)" for m in STORY_COLUMNS)
    froms = ", ".join(f"(SELECT max(low) AS low, max(high) AS high FROM ({fence[m]})) AS {m}_f" for m in STORY_COLUMNS)
    unusual = f"""SELECT 'anomaly' AS kind, measure AS subject, {null} AS other, {null} AS direction, x.value AS value, mid AS baseline, share AS comparison, k AS n,
      40 + least(share, 20) AS score FROM ({odd}), (SELECT count(*) FILTER ({any_odd}) AS k, 100.0::DOUBLE * count(*) FILTER ({any_odd}) / count(*) AS share FROM story, {froms})
      WHERE k > 0 ORDER BY far DESC LIMIT 1"""
    grouped = " UNION ALL ".join(segment_sql("story", c, "revenue") for c in ("channel", "grade"))
    gap = "100 * (best_average - overall_average) / abs(overall_average)"
    led = f"""SELECT 'segment' AS kind, best_group AS subject, category AS other, 'above' AS direction, {gap} AS value, overall_average AS baseline,
      best_average AS comparison, best_rows AS n, 30 + least(abs({gap}), 30) AS score FROM ({grouped}) WHERE abs({gap}) >= 3 AND n_groups >= 2"""
    ready = f"""SELECT 'forecast' AS kind, 'revenue' AS subject, 'order_date' AS other, CASE WHEN d >= 30 THEN 'ready' ELSE 'too short' END AS direction, d::DOUBLE AS value,
      30.0::DOUBLE AS baseline, NULL::DOUBLE AS comparison, d AS n, CASE WHEN d >= 30 THEN 45.0 ELSE 8.0 END::DOUBLE AS score
      FROM (SELECT count(DISTINCT order_date::DATE) AS d FROM story WHERE revenue IS NOT NULL)"""
    gaps = f"""SELECT 'quality' AS kind, 'stock_level' AS subject, 'blanks' AS other, {null} AS direction, p AS value, NULL::DOUBLE AS baseline, NULL::DOUBLE AS comparison,
      1::BIGINT AS n, 12.0::DOUBLE AS score FROM (SELECT round(100.0::DOUBLE * count(*) FILTER (stock_level IS NULL) / count(*), 2) AS p FROM story) WHERE p >= 20"""
    twice = f"""SELECT 'quality' AS kind, {null} AS subject, 'duplicates' AS other, {null} AS direction, (all_rows - count(*))::DOUBLE AS value, NULL::DOUBLE AS baseline,
      NULL::DOUBLE AS comparison, all_rows AS n, 10.0::DOUBLE AS score FROM (SELECT DISTINCT * FROM story), (SELECT count(*) AS all_rows FROM story) GROUP BY all_rows HAVING all_rows > count(*)"""
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in (trend, linked, unusual, led, ready, gaps, twice))


ORACLES["findings"] = f"""WITH {STORY_SQL}, found AS ({story_findings()})
SELECT kind, subject, other, direction, round(value, 4) AS value, round(baseline, 4) AS baseline, round(comparison, 4) AS comparison, n, round(score, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, subject, other) AS i FROM found) WHERE kind != 'relationship' OR i <= 3
ORDER BY score DESC LIMIT 12"""
ORACLES["finding_counts"] = f"""WITH {STORY_SQL}, found AS ({story_findings()})
SELECT kind, sum(CASE WHEN kind = 'anomaly' THEN n WHEN kind = 'forecast' AND direction != 'ready' THEN 0 ELSE 1 END)::BIGINT AS n_found FROM found GROUP BY 1"""

# -------------------------------------------- audits of the story table, briefing --
STORY_ALL = ("order_date", "revenue", "cost", "stock_level", "channel", "grade")
STORY_TEXTS = ("channel", "grade")


def story_issues() -> str:
    """Every check on the story table; the ones it passes come out empty."""
    pct = PCT.replace("messy", "story")
    ranks = "CASE WHEN pct >= 20 THEN 'critical' WHEN pct >= 2 THEN 'warning' ELSE 'notice' END"
    parts = [
        f"""SELECT 'duplicate_rows' AS kind, NULL::VARCHAR AS col, n, {pct} AS pct, CASE WHEN {pct} >= 5 THEN 'critical' ELSE 'warning' END AS severity
          FROM (SELECT (SELECT count(*) FROM story) - count(*) AS n FROM (SELECT DISTINCT * FROM story)) WHERE n > 0""",
        "SELECT 'missing_values', col, n, pct, " + ranks + f" FROM (SELECT col, n, {pct} AS pct FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS col, count(*) FILTER ({c} IS NULL" + (f" OR lower({strip(c)}) IN ({WORDS})" if c in STORY_TEXTS else "") + ") AS n FROM story"
            for c in STORY_ALL) + ") WHERE n > 0)",
        f"SELECT 'whitespace', col, n, {pct}, 'warning' FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS col, count(*) FILTER ({c} != {strip(c)}) AS n FROM story" for c in STORY_TEXTS) + ") WHERE n > 0",
        f"SELECT 'category_variants', col, sum(n)::BIGINT AS n, any_value(100.0::DOUBLE), 'warning' FROM ({variants_sql(STORY_TEXTS).replace('messy', 'story')}) WHERE v != canonical GROUP BY 2",
        "SELECT 'constant_column', col, n, 100.0, 'notice' FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS col, count(*) AS n, count(DISTINCT {c}) AS u FROM story" for c in STORY_ALL) + ") WHERE u = 1",
        f"SELECT 'impossible_values', col, n, {pct}, 'critical' FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS col, count(*) FILTER ({c} < 0) AS n FROM story" for c in ("revenue", "cost")) + ") WHERE n > 0",
        f"SELECT 'outliers', col, n, {pct}, CASE WHEN {pct} > 1 THEN 'warning' ELSE 'notice' END FROM ("
        + " UNION ALL ".join(fence_sql(c).replace("messy", "story") for c in STORY_COLUMNS) + ") WHERE n > 0",
    ]
    return issues_sql(" UNION ALL ".join(parts)).replace(f"1.0 / {N_COLS}", f"1.0 / {len(STORY_ALL)}")


STORY_SCORE = f"""SELECT score, {GRADE} AS grade, n_issues, n_critical, n_warning, n_notice, n_fixable, (SELECT count(*) FROM story) AS n_rows FROM (
  SELECT round(greatest(0, 100 - coalesce(sum(penalty), 0)), 1)::DOUBLE AS score, count(*) AS n_issues, count(*) FILTER (severity = 'critical') AS n_critical,
    count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'notice') AS n_notice, count(fix_action) AS n_fixable FROM i)"""
ORACLES["health_score_story"] = f"WITH {STORY_SQL}, i AS ({story_issues()}) {STORY_SCORE}"
ORACLES["passed_checks"] = f"""WITH {STORY_SQL}, i AS ({story_issues()})
SELECT "check" FROM (SELECT unnest([{", ".join(f"'{c}'" for c in RAW_ISSUES)}]) AS "check") WHERE "check" NOT IN (SELECT kind FROM i)"""
ORACLES["briefing"] = f"""WITH {STORY_SQL}, i AS ({story_issues()}), found AS ({story_findings()}),
listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, subject, other) AS k FROM found) WHERE kind != 'relationship' OR k <= 3
  ORDER BY score DESC LIMIT 12),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, pct_affected DESC, id) - 1 AS place FROM i)
SELECT kind, subject, round(value, 4) AS value, round(score, 4) AS score FROM (
  SELECT 'issue' AS kind, id AS subject, pct_affected AS value, 200.0::DOUBLE - place AS score FROM ranked WHERE severity = 'critical' AND place < 2
  UNION ALL SELECT kind, subject, value, 100.0::DOUBLE - (row_number() OVER (ORDER BY score DESC) - 1) FROM listed
  UNION ALL SELECT 'quality', grade, score, 40.0 FROM ({STORY_SCORE}) WHERE n_critical = 0
  UNION ALL SELECT 'shape', count(*) || ' rows, {len(STORY_ALL)} columns', count(*)::DOUBLE, 30.0 FROM story) ORDER BY score DESC LIMIT 5"""
ORACLES["quality_change"] = f"""WITH {MESSY_SQL}, i AS ({ALL_ISSUES}), s AS (SELECT round(greatest(0, 100 - sum(penalty)), 1)::DOUBLE AS after FROM i),
odd AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_custkey) = count(*) AS keyed FROM customer)
SELECT 'quality' AS kind, NULL::VARCHAR AS "column", 'down' AS direction, 100.0::DOUBLE AS before, after, round(after - 100, 1) AS pct_change, 85.0::DOUBLE AS score, NULL::VARCHAR AS names
FROM s, odd WHERE keyed AND lo >= q1 - 3 * (q3 - q1) AND hi <= q3 + 3 * (q3 - q1)"""
ORACLES["analysis_report_story"] = f"""WITH {STORY_SQL}, i AS ({story_issues()}), found AS ({story_findings()})
SELECT 'issue' AS section, kind, split_part(id, ':', 2) AS subject, pct_affected AS value, penalty AS score FROM i
UNION ALL SELECT 'finding', kind, subject, round(value, 4), round(score, 4) FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, subject, other) AS k FROM found) WHERE kind != 'relationship' OR k <= 3) WHERE place <= 12"""
ORACLES["dataset_summaries"] = f"""WITH {STORY_SQL}, {MESSY_SQL}, si AS ({story_issues()}), mi AS ({ALL_ISSUES})
SELECT added, "table", n_rows, n_cols, archetype, score, {GRADE} AS grade, is_cleaned FROM (
  SELECT 0::BIGINT AS added, 'story' AS "table", (SELECT count(*) FROM story) AS n_rows, {len(STORY_ALL)}::BIGINT AS n_cols, 'timeseries' AS archetype,
    round(greatest(0, 100 - sum(penalty)), 1)::DOUBLE AS score, true AS is_cleaned FROM si
  UNION ALL SELECT 1, 'messy', (SELECT count(*) FROM messy), {N_COLS}, 'tabular', round(greatest(0, 100 - sum(penalty)), 1)::DOUBLE, false FROM mi)"""
VARIED = " UNION ALL ".join(f"SELECT '{m}' AS m, stddev_samp({m}) / abs(avg({m})) AS v FROM story" for m in STORY_COLUMNS)
STORY_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM story" for a in STORY_COLUMNS for b in STORY_COLUMNS if a != b)
SUMMED = "CASE WHEN m IN ('revenue', 'cost') THEN 'sum' ELSE 'mean' END"
ORACLES["chart_candidates"] = f"""WITH {STORY_SQL},
m AS (SELECT m, v, row_number() OVER (ORDER BY m != 'revenue', v DESC) AS i FROM ({VARIED})),
spread AS (SELECT 'channel' AS c, stddev_samp(a) AS s FROM (SELECT avg(revenue) AS a FROM story GROUP BY channel)
  UNION ALL SELECT 'grade', stddev_samp(a) FROM (SELECT avg(revenue) AS a FROM story GROUP BY grade)),
best AS (SELECT arg_max(c, s) AS c FROM spread),
pair AS (SELECT a, b, r FROM ({STORY_PAIRS}), m x, m y WHERE x.m = a AND y.m = b AND x.i < y.i AND abs(r) <= 0.995 ORDER BY abs(r) DESC LIMIT 1)
SELECT kind, chart, x, y, agg, round(score, 4) AS score FROM (
  SELECT 'trend' AS kind, 'line' AS chart, 'order_date' AS x, 'revenue' AS y, 'sum' AS agg, 10 + least(count(DISTINCT order_date::DATE) / 100.0::DOUBLE, 1) AS score FROM story
  UNION ALL SELECT 'ranking', 'bar', c, 'revenue', 'sum', 9.0 FROM best
  UNION ALL SELECT 'relationship', 'scatter', a, b, NULL, 6 + 4 * abs(r) FROM pair WHERE abs(r) >= 0.35
  UNION ALL SELECT 'correlations', 'heatmap', string_agg(m, ',' ORDER BY i), NULL, NULL, 5.5 + least(count(*) / 20.0::DOUBLE, 0.5) FROM m
  UNION ALL SELECT 'distribution', 'histogram', m, NULL, NULL, 4 + least(v, 2) FROM m WHERE i = 1
  UNION ALL SELECT 'spread_by_group', 'box', c, 'revenue', NULL, 3.5 FROM best
  UNION ALL SELECT 'trend_secondary', 'line', 'order_date', m, {SUMMED}, 3 + least(v, 1.5) FROM m WHERE i = 2) ORDER BY score DESC LIMIT 6"""

# ---------------------------------------------------- comparison and what-if --
HALVES = """
before_half AS (SELECT * EXCLUDE (o_custkey) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
after_half AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice * 0.8::DOUBLE END AS o_totalprice,
    CASE WHEN o_orderkey % 6 = 0 THEN 'X' WHEN o_orderstatus = 'F' THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
    o_orderdate, o_orderpriority, o_totalprice * 0.1::DOUBLE AS rebate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
"""
ORACLES["aligned_columns"] = f"""WITH {HALVES}, a AS ({profile_sql('before_half', [c for c in ORDERS if c[0] != 'o_custkey'])}),
b AS ({profile_sql('after_half', [('o_orderkey', 'n'), ('o_totalprice', 'n'), ('o_orderstatus', 't'), ('o_orderdate', 'd'), ('o_orderpriority', 't'), ('rebate', 'n')])})
SELECT a."column" AS column_a, CASE WHEN b."column" = 'o_orderkey' THEN 'O_ORDERKEY' ELSE b."column" END AS column_b, a.semantic_type AS type_a, b.semantic_type AS type_b,
  CASE WHEN a."column" IS NULL THEN 'added' WHEN b."column" IS NULL THEN 'removed' ELSE 'shared' END AS status,
  coalesce(a.semantic_type != b.semantic_type, false) AS type_conflict
FROM a FULL OUTER JOIN b ON a."column" = b."column" """
SHAPE_CHANGES = """SELECT 'row_count' AS kind, NULL::VARCHAR AS "column", CASE WHEN nb > na THEN 'up' ELSE 'down' END AS direction, na::DOUBLE AS before,
  nb::DOUBLE AS after, 100.0::DOUBLE * (nb - na) / na AS pct_change, 95.0::DOUBLE AS score, NULL::VARCHAR AS names
  FROM (SELECT (SELECT count(*) FROM before_half) AS na, (SELECT count(*) FROM after_half) AS nb) WHERE na != nb
  UNION ALL SELECT 'columns_added', NULL, 'added', NULL, 1.0, NULL, 70.0, 'rebate'"""
CHANGE = 'kind, "column", direction, round(before, 4) AS before, round(after, 4) AS after, round(pct_change, 4) AS pct_change, round(score, 4) AS score, names'
ORACLES["shape_changes"] = f"WITH {HALVES} SELECT {CHANGE} FROM ({SHAPE_CHANGES})"
MEASURE_STATS = """SELECT *, CASE WHEN differ THEN mean_a ELSE sum_a END AS b, CASE WHEN differ THEN mean_b ELSE sum_b END AS a FROM (
  SELECT x."column", sum_a, mean_a, std_a, sum_b, mean_b, std_b,
    abs((SELECT count(*) FROM before_half) - (SELECT count(*) FROM after_half)) / (SELECT count(*) FROM before_half)::DOUBLE > 0.02 AS differ FROM
  (SELECT 'o_totalprice' AS "column", sum(o_totalprice) AS sum_a, avg(o_totalprice) AS mean_a, stddev_samp(o_totalprice) AS std_a FROM before_half
   UNION ALL SELECT 'o_orderkey', sum(o_orderkey)::DOUBLE, avg(o_orderkey), stddev_samp(o_orderkey) FROM before_half) x JOIN
  (SELECT 'o_totalprice' AS "column", sum(o_totalprice) AS sum_b, avg(o_totalprice) AS mean_b, stddev_samp(o_totalprice) AS std_b FROM after_half
   UNION ALL SELECT 'o_orderkey', sum(o_orderkey)::DOUBLE, avg(o_orderkey), stddev_samp(o_orderkey) FROM after_half) y ON x."column" = y."column")"""
MEASURE_CHANGES = f"""SELECT 'measure' AS kind, "column", CASE WHEN a > b THEN 'up' ELSE 'down' END AS direction, b AS before, a AS after, pct AS pct_change,
    40 + least(abs(pct), 200) / 4.0::DOUBLE AS score, NULL::VARCHAR AS names FROM (SELECT *, (a - b) / abs(b) * 100 AS pct FROM ({MEASURE_STATS})) WHERE abs(pct) >= 2
  UNION ALL SELECT 'spread', "column", CASE WHEN s > 0 THEN 'up' ELSE 'down' END, std_a, std_b, s, 35 + least(abs(s), 100) / 10.0::DOUBLE, NULL
  FROM (SELECT *, (a - b) / abs(b) * 100 AS pct, (std_b - std_a) / std_a * 100 AS s FROM ({MEASURE_STATS})) WHERE abs(pct) < 10 AND abs(s) >= 25"""
ORACLES["measure_changes"] = f"WITH {HALVES} SELECT {CHANGE} FROM ({MEASURE_CHANGES})"


def shares_sql(column: str) -> str:
    side = "(SELECT {c} AS value, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS s FROM {t} GROUP BY 1)"
    return f"""SELECT '{column}' AS "column", coalesce(x.value, y.value) AS value, x.s AS share_a, y.s AS share_b
  FROM {side.format(c=column, t='before_half')} x FULL OUTER JOIN {side.format(c=column, t='after_half')} y ON x.value = y.value"""


SHARES = " UNION ALL ".join(shares_sql(c) for c in ("o_orderstatus", "o_orderpriority"))
ORACLES["category_shares"] = f'WITH {HALVES} SELECT "column", value, round(share_a, 4) AS share_a, round(share_b, 4) AS share_b FROM ({SHARES})'
CATEGORY_CHANGES = f"""SELECT 'category_added' AS kind, "column", 'added' AS direction, NULL::DOUBLE AS before, count(*)::DOUBLE AS after, NULL::DOUBLE AS pct_change, 55.0::DOUBLE AS score, string_agg(value, ', ' ORDER BY value) AS names
    FROM ({SHARES}) WHERE share_a IS NULL GROUP BY 2
  UNION ALL SELECT 'category_removed', "column", 'removed', count(*)::DOUBLE, NULL, NULL, 58.0, string_agg(value, ', ' ORDER BY value) FROM ({SHARES}) WHERE share_b IS NULL GROUP BY 2
  UNION ALL SELECT 'category_shift', "column", CASE WHEN share_b > share_a THEN 'up' ELSE 'down' END, share_a, share_b, share_b - share_a, 45 + least(abs(share_b - share_a), 50) / 2, value
    FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY abs(share_b - share_a) DESC, value DESC) AS i FROM ({SHARES}) WHERE abs(share_b - share_a) >= 3) WHERE i = 1"""
ORACLES["category_changes"] = f"WITH {HALVES} SELECT {CHANGE} FROM ({CATEGORY_CHANGES})"
ORACLES["compare"] = f"""WITH {HALVES} SELECT {CHANGE} FROM (SELECT * FROM ({SHAPE_CHANGES}) UNION ALL SELECT * FROM ({MEASURE_CHANGES}) UNION ALL SELECT * FROM ({CATEGORY_CHANGES}))
ORDER BY score DESC LIMIT 12"""
ORACLES["comparable"] = f"WITH {HALVES} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", true AS in_first, true AS in_second, (SELECT count({c}) FROM before_half) AS n_first, (SELECT count({c}) FROM after_half) AS n_second,
  (SELECT count(DISTINCT {c}) FROM before_half) AS distinct_first, (SELECT count(DISTINCT {c}) FROM after_half) AS distinct_second,
  (SELECT count(*) FROM (SELECT {c} FROM before_half INTERSECT SELECT {c} FROM after_half)) AS distinct_common, true AS comparable"""
    for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
) + " UNION ALL SELECT 'rebate', false, true, NULL, NULL, NULL, NULL, NULL, true"
ORACLES["simulate_direct"] = """
SELECT 'ok' AS status, 'direct' AS basis, 'l_extendedprice' AS target, 'l_extendedprice' AS driver, 200.0::DOUBLE AS pct_change, round(sum(l_extendedprice), 2) AS base_total,
  round(avg(l_extendedprice), 2) AS base_average, round(sum(l_extendedprice) * 3, 2) AS projected_total, round(avg(l_extendedprice) * 3, 2) AS projected_average,
  200.0::DOUBLE AS delta_pct, count(*) AS rows_used, NULL::DOUBLE AS r, NULL::VARCHAR AS strength FROM lineitem"""
ORACLES["simulate_driver"] = f"""
SELECT CASE WHEN ok THEN 'ok' ELSE 'unsupported' END AS status, 'relationship' AS basis, 'p_retailprice' AS target, 'p_partkey' AS driver, 20.0::DOUBLE AS pct_change,
  round(total, 2) AS base_total, round(average, 2) AS base_average, CASE WHEN ok THEN round((average + shift) * n, 2) END AS projected_total,
  CASE WHEN ok THEN round(average + shift, 2) END AS projected_average, CASE WHEN ok THEN round(100 * shift / abs(average), 2) END AS delta_pct, n AS rows_used,
  round(r, 2) AS r, {BAND} AS strength FROM (
  SELECT abs(corr(p_retailprice, p_partkey)) >= 0.3 AND count(*) >= 20 AS ok, sum(p_retailprice) AS total, avg(p_retailprice) AS average, count(*) AS n,
    corr(p_retailprice, p_partkey) AS r, regr_slope(p_retailprice, p_partkey) * avg(p_partkey) * 0.2::DOUBLE AS shift FROM part)"""
ORACLES["drivers"] = """
SELECT 'p_retailprice' AS target, driver, round(r, 6) AS r, n, coalesce(abs(r) > 0.3 AND row_number() OVER (ORDER BY abs(r) DESC) = 1, false) AS suggested FROM (
  SELECT 'p_partkey' AS driver, corr(p_retailprice, p_partkey) AS r, count(*) AS n FROM part
  UNION ALL SELECT 'p_size', corr(p_retailprice, p_size), count(*) FROM part)"""

# ---------------------------------------------------------------- chart data --
ORACLES["line_data"] = f"SELECT period, round(value, 4) AS value FROM {resample_sql('orders', 'o_orderdate', 'o_totalprice', 'W', 'max')}"
ORACLES["bar_data"] = """SELECT "group", round(value, 4) AS value, "rows" FROM (
  SELECT l_quantity::VARCHAR AS "group", avg(l_extendedprice) AS value, count(*) AS "rows" FROM lineitem GROUP BY 1) ORDER BY value, "group" LIMIT 20"""
ORACLES["scatter_fit"] = """SELECT unnest([x0, x1]) AS x, round(unnest([s * x0 + c, s * x1 + c]), 4) AS y, n FROM (
  SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS c, min(l_quantity) AS x0, max(l_quantity) AS x1, count(*) AS n FROM lineitem)"""
ORACLES["scatter_points"] = f"WITH {MESSY_SQL} SELECT customer_ref, age AS x, round(gappy, 4) AS y FROM messy WHERE gappy IS NOT NULL"


def histogram_sql(table: str, c: str) -> str:
    return f"""SELECT bin, round(lo + bin * w, 4) AS bin_start, round(lo + (bin + 1) * w, 4) AS bin_end, count(*) AS n, round(mean, 4) AS mean FROM (
  SELECT least(floor(({c} - lo) / w), 29)::BIGINT AS bin, lo, w, mean FROM {table},
    (SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c})) / 30.0::DOUBLE AS w, avg({c}) AS mean FROM {table})) GROUP BY bin, lo, w, mean"""


ORACLES["histogram"] = histogram_sql("lineitem", "l_extendedprice")
ORACLES["box_stats"] = """
WITH top AS (SELECT l_discount AS g FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, g::VARCHAR LIMIT 8),
q AS (SELECT l_discount AS g, quantile_cont(l_extendedprice, 0.25) AS q25, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS q75
  FROM lineitem WHERE l_discount IN (SELECT g FROM top) GROUP BY 1),
x AS (SELECT q.*, l_extendedprice AS v, l_extendedprice BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM lineitem JOIN q ON l_discount = g)
SELECT g::VARCHAR AS "group", round(q25, 4) AS q25, round(m, 4) AS median, round(q75, 4) AS q75, count(*) AS "rows", round(min(v) FILTER (inside), 4) AS whisker_low,
  round(max(v) FILTER (inside), 4) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM x GROUP BY g, q25, m, q75"""
ORACLES["heatmap_data"] = ORACLES["correlation_matrix"].replace("round(r, 6) AS r, n FROM", "round(r, 2) AS r FROM")
ORACLES["map_points"] = f"""WITH {PLACED_SQL} SELECT c_custkey, round(latitude, 4) AS lat, round(longitude, 4) AS lon, round(reading, 4) AS value,
  round(5 + 21 * (reading - lo) / (hi - lo), 4) AS marker_size FROM ok, (SELECT min(reading) AS lo, max(reading) AS hi FROM ok)"""
ORACLES["map_view"] = f"""WITH {PLACED_SQL} SELECT round(avg(latitude), 4) AS centre_lat, round(avg(longitude), 4) AS centre_lon,
  round(greatest(0, least(16, least(log2(360 / (max(longitude) - min(longitude))), log2(180 / (max(latitude) - min(latitude)))) - 0.4::DOUBLE)), 2) AS zoom FROM ok"""
ORACLES["densest_cell"] = f"""WITH {PLACED_SQL} SELECT round(i * 0.1::DOUBLE, 4) AS lat, round(j * 0.1::DOUBLE, 4) AS lon, n AS n_points FROM (
  SELECT round_even(latitude / 0.1::DOUBLE, 0)::BIGINT AS i, round_even(longitude / 0.1::DOUBLE, 0)::BIGINT AS j, count(*) AS n FROM ok GROUP BY 1, 2)
WHERE n >= 2 ORDER BY n DESC, i, j LIMIT 1"""
ORACLES["geo_stats"] = f"""WITH {PLACED_SQL} SELECT count(*) AS n_points, (SELECT count(*) FROM placed) - count(*) AS n_dropped,
  (SELECT count(*) FILTER (latitude IS NULL OR longitude IS NULL) FROM placed) AS n_without_coordinate, round(min(latitude), 4) AS lat_min, round(max(latitude), 4) AS lat_max,
  round(min(longitude), 4) AS lon_min, round(max(longitude), 4) AS lon_max, round(min(reading), 4) AS value_min, round(max(reading), 4) AS value_max,
  round(avg(reading), 4) AS value_mean FROM ok"""
ORACLES["world_time_series"] = f"""SELECT period, round(value, 4) AS value, round(avg(value) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling_mean
FROM {ORDER_MONTHS}"""
ORACLES["world_geo"] = ORACLES["geo_stats"].replace("min(reading)", "min(c_custkey)::DOUBLE").replace("max(reading)", "max(c_custkey)::DOUBLE").replace(
    "avg(reading)", "avg(c_custkey)")
ORACLES["world_tabular"] = histogram_sql("part", "p_partkey")

# ----------------------------------------------------------------- text jobs --
DIGITS = """CASE WHEN v = 0 THEN v ELSE
  (v / pow(10.0::DOUBLE, greatest(floor(log10(abs(v))) - 5, 0)) * pow(10.0::DOUBLE, greatest(5 - floor(log10(abs(v))), 0)))::BIGINT::DOUBLE
    / pow(10.0::DOUBLE, greatest(5 - floor(log10(abs(v))), 0)) * pow(10.0::DOUBLE, greatest(floor(log10(abs(v))) - 5, 0)) END"""


def tokens_sql(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, {DIGITS} AS number FROM (
    SELECT {key}, TRY_CAST(rtrim(replace(t, ',', ''), '.') AS DOUBLE) AS v FROM (
      SELECT {key}, unnest(regexp_extract_all(text, '(\\p{{L}}?-?[0-9][0-9,]*\\.?[0-9]*)', 1)) AS t FROM {table}) WHERE NOT regexp_matches(t, '^\\p{{L}}')) WHERE v IS NOT NULL"""


ORACLES["number_tokens"] = f"SELECT doc_id, count(*) AS n_numbers, max(number) AS largest FROM ({tokens_sql('documents', 'doc_id')}) GROUP BY 1"
ORACLES["grounding_audit"] = f"""
WITH stated AS ({tokens_sql('documents', 'doc_id')}),
raw AS (SELECT number FROM ({tokens_sql('benchmark', 'item_id')}) UNION ALL SELECT {DIGITS} FROM (SELECT p_retailprice AS v FROM part)),
allowed AS (SELECT number FROM raw UNION SELECT abs(number) FROM raw),
bad AS (SELECT doc_id, count(*) AS k FROM stated WHERE NOT (number = floor(number) AND number BETWEEN 0 AND 12)
  AND number NOT IN (SELECT number FROM allowed) AND abs(number) NOT IN (SELECT number FROM allowed) GROUP BY 1),
per AS (SELECT doc_id, count(*) AS n FROM stated GROUP BY 1)
SELECT d.doc_id, coalesce(per.n, 0) AS n_numbers, coalesce(bad.k, 0) AS n_unsupported, bad.k IS NULL AS grounded
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN bad ON d.doc_id = bad.doc_id"""
EDGE = r"[^\p{L}\p{N}\p{M}_]"


def intent_sql(c: str) -> str:
    cases = []
    for name, words in INTENTS:
        stems = "|".join(w[:-1] for w in words if w.endswith("*"))
        plain = "|".join(w for w in words if not w.endswith("*"))
        tests = [f"regexp_matches(lower({c}), '(^|{EDGE})({plain})({EDGE}|$)')"]
        if stems:
            tests.append(f"regexp_matches(lower({c}), '(^|{EDGE})({stems})')")
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(cases) + " END"


ORACLES["tag_intent"] = f"SELECT conv_id, turn, {intent_sql('text')} AS intent FROM conversations"
ORACLES["intents_of_documents"] = f"SELECT {intent_sql('text')} AS intent, count(*) AS n FROM documents GROUP BY 1"
NAMES = sorted(["text", "lang", "source", "the", "time", "part", "order", "user_id"], key=len, reverse=True)
ORACLES["mentioned_columns"] = "SELECT doc_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), '(^|{EDGE})({n}|{n.replace('_', ' ')})({EDGE}|$)') THEN '{n}' END" for n in NAMES) + ") AS mentioned FROM documents"

# ------------------------------------- dots, infinities, null and repeated keys --
ORACLES["dotted_names_profile"] = """
SELECT 'a' AS "column", count(*) FILTER (c_custkey IS NULL) AS n_null, count(DISTINCT c_custkey) AS n_unique, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max, round(avg(c_custkey), 4) AS mean FROM customer
UNION ALL SELECT 'a.1', count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment), NULL, NULL, NULL FROM customer
UNION ALL SELECT 'b.c', count(*) FILTER (c_acctbal IS NULL), count(DISTINCT c_acctbal), round(min(c_acctbal), 4), round(max(c_acctbal), 4), round(avg(c_acctbal), 4) FROM customer
UNION ALL SELECT 'd.e.f', count(*) FILTER (c_name IS NULL), count(DISTINCT c_name), NULL, NULL, NULL FROM customer"""
ORACLES["dotted_names_audit"] = """
WITH t AS (SELECT c_mktsegment AS a, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS b FROM customer)
SELECT 'duplicate_rows' AS kind, '' AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM t)) AS n_affected FROM t
UNION ALL SELECT 'missing_values', 'b.c', count(*) FILTER (b IS NULL) FROM t"""
WIDE_PRIMES = (97, 101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163, 167)
WIDE_SQL = "wide AS (SELECT " + ", ".join(f"(l_orderkey * {p} % 1009 + l_quantity * ({p} % 7))::DOUBLE AS x{i}" for i, p in enumerate(WIDE_PRIMES)) + " FROM lineitem)"
ORACLES["correlation_matrix_wide"] = f"""
WITH {WIDE_SQL}, p AS ({pairs_sql("wide", [f"x{i}" for i in range(15)])})
SELECT a, b, round(r, 6) AS r, n FROM (SELECT a, b, r, n FROM p UNION ALL SELECT b, a, r, n FROM p
  UNION ALL {" UNION ALL ".join(f"SELECT 'x{i}', 'x{i}', 1.0, count(x{i}) FROM wide" for i in range(15))})"""
FINITE_SQL = "f AS (SELECT CASE WHEN l_orderkey % 97 != 0 THEN l_extendedprice::DOUBLE END AS price, l_quantity::DOUBLE AS quantity FROM lineitem)"
ORACLES["correlation_with_infinities"] = f"WITH {FINITE_SQL} SELECT a, b, round(r, 6) AS r, n FROM ({pairs_sql('f', ['price', 'quantity'])})"
ORACLES["quantiles_with_infinities"] = f"""WITH {FINITE_SQL}
SELECT 'price' AS measure, p::DOUBLE AS p, round(quantile_cont(price, p), 4) AS q FROM f, (SELECT 0.1 AS p UNION ALL SELECT 0.5 UNION ALL SELECT 0.9) GROUP BY p""".replace(
    "quantile_cont(price, p)", "CASE p WHEN 0.1 THEN quantile_cont(price, 0.1) WHEN 0.5 THEN quantile_cont(price, 0.5) ELSE quantile_cont(price, 0.9) END")
ORACLES["histogram_with_infinities"] = f"""WITH {FINITE_SQL}, e AS (SELECT min(price) AS lo, (max(price) - min(price)) / 8 AS w, avg(price) AS mean FROM f),
b AS (SELECT least(floor((price - lo) / w), 7)::BIGINT AS bin, lo, w, mean FROM f, e WHERE price IS NOT NULL)
SELECT bin, round(lo + bin * w, 4) AS bin_start, round(lo + (bin + 1) * w, 4) AS bin_end, count(*) AS n, round(mean, 4) AS mean FROM b GROUP BY bin, lo, w, mean"""
ORACLES["rank_hundred_groups"] = """
SELECT l_partkey::VARCHAR AS "group", sum(l_quantity)::DOUBLE AS value, count(*) AS "rows", count(*) OVER () AS n_groups
FROM lineitem GROUP BY l_partkey ORDER BY value DESC, "group" LIMIT 100"""
ORACLES["resample_median_with_null_keys"] = """
SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, last_day(l_shipdate)::DATE AS period, round(median(l_extendedprice), 4) AS value
FROM lineitem GROUP BY 1, 2"""
ORACLES["grounding_with_repeated_keys"] = f"""
WITH stated AS ({tokens_sql('documents', 'doc_id')}), allowed AS (SELECT abs({DIGITS}) AS size FROM (SELECT p_retailprice AS v FROM part)),
bad AS (SELECT doc_id, count(*) AS k FROM stated WHERE NOT (number = floor(number) AND number BETWEEN 0 AND 12) AND abs(number) NOT IN (SELECT size FROM allowed) GROUP BY 1),
per AS (SELECT doc_id, count(*) AS n FROM stated GROUP BY 1)
SELECT CASE WHEN d.doc_id % 5 > 0 THEN d.lang END AS lang, coalesce(per.n, 0) AS n_numbers, coalesce(bad.k, 0) AS n_unsupported, bad.k IS NULL AS grounded
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN bad ON d.doc_id = bad.doc_id"""
