"""Audit a table: named issues, what each would take to repair, and a score.

The scan that profiles the table also gathers nearly everything the checks
need (``operators.facts``), so an audit costs: that scan, one shuffle of row
fingerprints for duplicates, one small shuffle for spelling variants, and the
quantile passes for the outlier fences. The issues themselves are a handful of
rows per column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.functions.names import ID_NAME_AUDIT, is_identifier, plausible_range
from tablescry.functions.scalars import (
    is_numeric_type,
    is_text_type,
    parse_number,
    present,
    shared_marker,
    strip_ws,
    undecorated_number,
    variant_key,
)
from tablescry.operators.aggregates import number_of, outside
from tablescry.operators.profile import SMALL_VOCABULARY, TableProfile, profile_table
from tablescry.operators.quantiles import quantile_table
from tablescry.operators.value_counts import unpivoted, value_counts

# What a kind of issue can cost at most.
PENALTY_CEILING = {
    "duplicate_rows": 22.0,
    "missing_values": 20.0,
    "empty_column": 14.0,
    "numeric_as_text": 12.0,
    "impossible_values": 12.0,
    "mixed_types": 10.0,
    "outliers": 9.0,
    "category_variants": 9.0,
    "duplicate_columns": 8.0,
    "whitespace": 6.0,
    "constant_column": 5.0,
}
# Lower bounds of the grades.
GRADES = ((90.0, "Excellent"), (75.0, "Good"), (60.0, "Fair"), (40.0, "Poor"))
# The audit's thresholds.
DUPLICATES_CRITICAL_PCT = 5.0
EMPTY_PCT, MANY_NULLS_PCT, SOME_NULLS_PCT = 99.5, 20.0, 2.0
NUMBER_SHARE, MINORITY_SHARE, MIXED_MIN_VALUES = 0.9, 0.02, 10
MAX_VARIANT_VOCABULARY = 400
FENCE, MIN_FENCE_ROWS, MAX_OUTLIER_ROWS = 3.0, 12, 12
CRITICAL_FLOOR = 0.25

CHECKS = (
    "duplicate_rows", "duplicate_columns", "missing_values", "numeric_as_text", "mixed_types",
    "whitespace", "category_variants", "constant_column", "impossible_values", "outliers",
)
SEVERITIES = ("critical", "warning", "notice")

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("n_affected", T.LongType()),
        T.StructField("pct_affected", T.DoubleType()),
        T.StructField("fix_action", T.StringType()),
        T.StructField("fix_column", T.StringType()),
        T.StructField("fix_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _pct(part: int, whole: int) -> float:
    return round(100.0 * part / whole, 2) if whole else 0.0


def _issue(kind: str, severity: str, n: int, pct: float, column: str | None = None, fix: str | None = None,
           params: dict[str, Any] | None = None, **evidence: Any) -> tuple:
    columns = [column] if column else []
    as_text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (params or {}).items() if v is not None}
    return (
        f"{kind}:{'+'.join(columns)}", kind, severity, columns, int(n), float(pct), fix, column if fix else None,
        as_text, {k: v if isinstance(v, str) else json.dumps(v) for k, v in evidence.items()},
    )


# ------------------------------------------------------------ duplicate rows --
def row_fingerprint(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row: two 64-bit hashes with unlike seeds.

    Nulls leave a hash unchanged, so a mask of the nulls is hashed along;
    without it (null, 'a') and ('a', null) would look alike.
    """
    columns = [
        F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType) else present(F.col(f"`{f.name}`"), f.dataType)
        for f in df.schema.fields
    ]
    mask = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return [
        F.xxhash64(F.lit(1), mask, *columns).alias("_h1"),
        F.xxhash64(F.lit(2), *reversed(columns), mask).alias("_h2"),
    ]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column: n_rows, n_distinct, n_duplicates.

    Only fingerprints are shuffled, combined per task first, so neither wide
    rows nor one row repeated a billion times weigh on the shuffle.
    """
    groups = df.select(*row_fingerprint(df)).groupBy("_h1", "_h2").agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


# --------------------------------------------------------- duplicate columns --
def duplicate_column_pairs(df: DataFrame, known: TableProfile) -> list[tuple[str, str]]:
    """(column, earlier column) pairs that agree on every row.

    Equal type, null count and hash total only nominate a pair; one more pass
    over just the nominated columns compares the values themselves.
    """
    alike: dict[tuple, list[str]] = {}
    for c in known.columns:
        facts = known.facts.columns[c["column"]]
        alike.setdefault((c["dtype"], facts["n_null"], facts["fingerprint"]), []).append(c["column"])
    groups, confirmed = [g for g in alike.values() if len(g) > 1], {}
    while groups:  # each column meets its group's first; those that differ from it make the next group
        nominated = [(column, group[0]) for group in groups for column in group[1:]]
        row = df.agg(*[
            F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"e{i}") for i, (a, b) in enumerate(nominated)
        ]).first()
        equal = {pair for i, pair in enumerate(nominated) if row[f"e{i}"]}
        confirmed |= dict(equal)
        rest = [[column for column in group[1:] if (column, group[0]) not in equal] for group in groups]
        groups = [g for g in rest if len(g) > 1]
    return [(c["column"], confirmed[c["column"]]) for c in known.columns if c["column"] in confirmed]


# ------------------------------------------------------------ text vs number --
def number_markers(known: TableProfile, column: str) -> tuple[str, str]:
    """The unit-like prefix and suffix that every value of a text column shares."""
    facts = known.facts.columns[column]
    if facts.get("head_min") is None:
        return "", ""
    shortest = facts["shortest"]
    prefix = shared_marker(facts["head_min"], facts["head_max"], shortest)
    suffix = shared_marker(facts["tail_min"], facts["tail_max"], shortest - len(prefix), at_start=False)
    return prefix, suffix


def numbers_in_text(df: DataFrame, known: TableProfile, columns: Sequence[str]) -> dict[str, dict[str, Any]]:
    """How many values of each text column are numbers once undecorated. One scan."""
    wanted: list[Column] = []
    for i, name in enumerate(columns):
        text = strip_ws(F.col(f"`{name}`"))
        number = undecorated_number(F.col(f"`{name}`"), *number_markers(known, name))
        plain = (text == number.cast("string")) | (text == number.try_cast("long").cast("string"))
        wanted += [
            F.count(text).alias(f"n{i}"),
            F.count(number).alias(f"k{i}"),
            F.count_if(~F.coalesce(plain, F.lit(False)) & text.isNotNull()).alias(f"d{i}"),
            F.min(text).alias(f"e{i}"),
        ]
    if not wanted:
        return {}
    row = df.agg(*wanted).first()
    return {
        name: {"n_values": row[f"n{i}"], "n_numbers": row[f"k{i}"], "n_decorated": row[f"d{i}"], "example": row[f"e{i}"]}
        for i, name in enumerate(columns)
    }


def mixed_examples(df: DataFrame, column: str, numbers_are_odd: bool, k: int = 3) -> list[str]:
    """The k smallest minority values of a mixed column."""
    text = strip_ws(F.col(f"`{column}`"))
    number = parse_number(F.regexp_replace(text, r"(?U)[,\s]", ""))
    odd = number.isNotNull() if numbers_are_odd else number.isNull()
    rows = df.select(text.alias("t")).where(F.col("t").isNotNull() & odd).orderBy("t").limit(k).collect()
    return [row["t"] for row in rows]


# --------------------------------------------------------- spelling variants --
def spelling_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, variant, canonical, n): spellings that differ only by case and punctuation.

    Works on the value counts of columns with at most 400 stripped values; the
    most frequent spelling of a key is canonical, ties go to the smaller text.
    """
    return _variants(value_counts(df, columns, strip=True))


def _variants(counts: DataFrame) -> DataFrame:
    sizes = counts.groupBy("column").agg(F.count("*").alias("vocabulary")).where(F.col("vocabulary").between(2, MAX_VARIANT_VOCABULARY))
    keyed = counts.join(F.broadcast(sizes.select("column")), "column").withColumn("key", variant_key(F.col("value"))).where("key != ''")  # a row for each column
    spelled = keyed.groupBy("column", "key").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"), F.count("*").alias("spellings"))
    return (
        keyed.join(spelled.where("spellings > 1").drop("spellings"), ["column", "key"])
        .where("value != canonical")
        .select("column", "key", F.col("value").alias("variant"), "canonical", "n")
    )


# ------------------------------------------------------------------ outliers --
def fences(df: DataFrame, measures: Sequence[str], known: TableProfile, min_rows: int = MIN_FENCE_ROWS) -> dict[str, dict[str, float]]:
    """Low and high fence, three quartile ranges out, per measure that has any spread.

    Quantiles are kept with the profile, so an audit and the findings of one
    table share them.
    """
    usable = [m for m in measures if known.facts.columns[m].get("n_numbers", 0) >= min_rows]
    missing = {m: number_of(df, m) for m in usable if m not in known.quantiles}
    known.quantiles |= quantile_table(df, missing, [0.1, 0.25, 0.5, 0.75, 0.9])
    found = {}
    for name in usable:
        q = known.quantiles[name]
        spread = q[0.75] - q[0.25]
        if spread > 0:
            found[name] = {"low": q[0.25] - FENCE * spread, "high": q[0.75] + FENCE * spread, "median": q[0.5],
                           "p10": q[0.1], "p90": q[0.9]}
    return found


def outlier_fences(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The fences as rows, with how many values lie beyond them."""
    known = profile_table(df.select(*[F.col(f"`{m}`") for m in measures]), "sketch")
    bounds = fences(df, measures, known)
    counts = count_outside(df, {m: (b["low"], b["high"]) for m, b in bounds.items()})
    rows = [(m, b["low"], b["high"], b["median"], counts[m]) for m, b in bounds.items()]
    return df.sparkSession.createDataFrame(rows, "measure string, low double, high double, median double, n_outside long")


def count_outside(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> dict[str, int]:
    if not bounds:
        return {}
    row = df.agg(*[
        F.count_if(outside(number_of(df, m), low, high)).alias(f"o{i}") for i, (m, (low, high)) in enumerate(bounds.items())
    ]).first()
    return dict(zip(bounds, row))


def worst_outliers(df: DataFrame, key: Sequence[str], measures: Sequence[str], k: int = MAX_OUTLIER_ROWS) -> DataFrame:
    """Up to k rows per measure, farthest past the fence first.

    The rank is a window per measure over outlying rows only, cut to the k rows
    of each task beforehand by Spark's window group limit.
    """
    known = profile_table(df.select(*[F.col(f"`{m}`") for m in measures]), "sketch")
    bounds = fences(df, measures, known)
    keys = [F.col(f"`{k_}`") for k_ in key]
    if not bounds:
        return df.sparkSession.createDataFrame([], "measure string").join(df.select(*keys).limit(0))
    table = df.sparkSession.createDataFrame(
        [(m, b["low"], b["high"], b["median"]) for m, b in bounds.items()],
        "measure string, low double, high double, median double",
    )
    values = unpivoted(df, {m: number_of(df, m) for m in bounds}, dict(zip(key, keys)), "measure")
    odd = (
        values.join(F.broadcast(table), "measure")  # one row per measure
        .where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
        .withColumn("distance", F.greatest(F.col("low") - F.col("value"), F.col("value") - F.col("high")))
    )
    order = Window.partitionBy("measure").orderBy(F.desc("distance"), *[F.col(f"`{k_}`") for k_ in key])
    return (
        odd.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .select(
            "measure", "position", *keys, "value",
            F.when(F.col("median") != 0, F.col("value") / F.col("median")).alias("ratio"),
            F.when(F.col("value") > F.col("high"), "above").otherwise("below").alias("direction"),
        )
    )


# --------------------------------------------------------------------- audit --
def issue_rows(df: DataFrame, known: TableProfile | None = None, checks: Sequence[str] = CHECKS) -> list[tuple]:
    """Every issue of the wanted checks, as rows of ``ISSUE_SCHEMA``."""
    known = known if known is not None and known.facts and _has_audit(known) else profile_table(df, "sketch", audit=True)
    n_rows, facts = known.n_rows, known.facts.columns
    if not n_rows:
        return []
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [c["column"] for c in known.columns]
    texts = [n for n in names if is_text_type(types[n])]
    issues: list[tuple] = []

    if "duplicate_rows" in checks:
        n = duplicate_rows(df).first()["n_duplicates"]
        if n:
            pct = _pct(n, n_rows)
            severity = "critical" if pct >= DUPLICATES_CRITICAL_PCT else "warning"
            issues.append(_issue("duplicate_rows", severity, n, pct, fix="drop_duplicates"))

    if "duplicate_columns" in checks:
        for column, earlier in duplicate_column_pairs(df, known):
            issues.append(_issue("duplicate_columns", "warning", n_rows, 100.0, column, "drop_column", duplicate_of=earlier))

    if "missing_values" in checks:
        for name in names:
            blank, words = facts[name]["n_null"], facts[name].get("n_words_for_missing", 0)
            total = blank + words
            if not total:
                continue
            pct = _pct(total, n_rows)
            if pct >= EMPTY_PCT:
                issues.append(_issue("empty_column", "critical", total, pct, name, "drop_column"))
                continue
            severity = "critical" if pct >= MANY_NULLS_PCT else "warning" if pct >= SOME_NULLS_PCT else "notice"
            params = {"strategy": "median"} if is_numeric_type(types[name]) else {"strategy": "label", "value": "Unknown"}
            issues.append(_issue("missing_values", severity, total, pct, name, "fill_missing", params,
                                 n_blank=blank, n_text_sentinel=words))

    if "numeric_as_text" in checks:
        candidates = [
            n for n in texts
            if not is_identifier(n, ID_NAME_AUDIT) and n_rows > facts[n]["n_null"]
            and facts[n]["n_with_digit"] >= NUMBER_SHARE * (n_rows - facts[n]["n_null"])
        ]
        for name, seen in numbers_in_text(df, known, candidates).items():
            if seen["n_numbers"] / seen["n_values"] >= NUMBER_SHARE and seen["n_decorated"]:
                issues.append(_issue("numeric_as_text", "critical", seen["n_numbers"], _pct(seen["n_numbers"], n_rows),
                                     name, "to_numeric", example=seen["example"],
                                     parse_rate=round(seen["n_numbers"] / seen["n_values"], 3)))

    if "mixed_types" in checks:
        for name in texts:
            n_values = n_rows - facts[name]["n_null"]
            if n_values < MIXED_MIN_VALUES:
                continue
            share = facts[name]["n_bare_numbers"] / n_values
            if MINORITY_SHARE < share < NUMBER_SHARE:
                numbers_are_odd = share < 0.5
                n = facts[name]["n_bare_numbers"] if numbers_are_odd else n_values - facts[name]["n_bare_numbers"]
                issues.append(_issue("mixed_types", "warning", n, _pct(n, n_rows), name, share_numeric=round(share, 3),
                                     examples=mixed_examples(df, name, numbers_are_odd)))

    if "whitespace" in checks:
        for name in texts:
            n = facts[name]["n_untidy"]
            if n:
                issues.append(_issue("whitespace", "warning", n, _pct(n, n_rows), name, "trim_whitespace"))

    if "category_variants" in checks:
        small = [n for n in texts if known.counts is not None and facts[n]["approx_distinct"] <= SMALL_VOCABULARY]
        mappings: dict[str, dict[str, str]] = {}
        counts: dict[str, int] = {}
        # at most 400 spellings per column
        stripped = known.counts.where(F.col("column").isin(*small)).groupBy(
            "column", strip_ws(F.col("value")).alias("value")).agg(F.sum("n").alias("n")) if small else None
        for row in _variants(stripped).orderBy("column", "variant").collect() if small else []:
            mappings.setdefault(row["column"], {})[row["variant"]] = row["canonical"]
            counts[row["column"]] = counts.get(row["column"], 0) + row["n"]
        for name in small:
            if name in mappings:
                issues.append(_issue("category_variants", "warning", counts[name], _pct(counts[name], n_rows), name,
                                     "merge_categories", {"mapping": mappings[name]}, n_spellings=len(mappings[name])))

    if "constant_column" in checks:
        for c in known.columns:
            if c["n_unique"] == 1:
                issues.append(_issue("constant_column", "notice", n_rows, 100.0, c["column"], "drop_column"))

    if "impossible_values" in checks:
        rules = {n: plausible_range(n) for n in names if is_numeric_type(types[n])}
        rules = {
            n: rule for n, rule in rules.items()
            if rule and facts[n]["min"] is not None
            and ((rule[0] is not None and facts[n]["min"] < rule[0]) or (rule[1] is not None and facts[n]["max"] > rule[1]))
        }
        for name, n in count_outside(df, rules).items():
            low, high = rules[name]
            issues.append(_issue("impossible_values", "critical", n, _pct(n, n_rows), name, "drop_invalid",
                                 {"low": low, "high": high}))

    if "outliers" in checks:
        measures = [n for n in known.of_type("numeric") if not is_identifier(n, ID_NAME_AUDIT)]
        bounds = fences(df, measures, known)
        for name, n in count_outside(df, {m: (b["low"], b["high"]) for m, b in bounds.items()}).items():
            if n:
                pct = _pct(n, n_rows)
                low, high = bounds[name]["low"], bounds[name]["high"]
                issues.append(_issue("outliers", "warning" if pct > 1 else "notice", n, pct, name, "cap_outliers",
                                     {"low": low, "high": high}, median=bounds[name]["median"]))
    return issues


def _has_audit(known: TableProfile) -> bool:
    return all("fingerprint" in f for f in known.facts.columns.values())


def with_penalty(issues: DataFrame, n_cols: int) -> DataFrame:
    """Each issue's cost: its ceiling times the root of its reach.

    A column issue reaches only its share of the columns; a critical one costs
    at least a quarter of its ceiling.
    """
    ceiling = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(cost)) for kind, cost in PENALTY_CEILING.items()], F.lit(5.0))
    share = F.when(F.size("columns") > 0, F.size("columns") / F.lit(float(max(n_cols, 1)))).otherwise(F.lit(1.0))
    reach = F.greatest(F.col("pct_affected") / 100.0 * share, F.lit(0.0))
    cost = ceiling * F.least(F.lit(1.0), F.sqrt(reach))
    floor = F.when(F.col("severity") == "critical", ceiling * CRITICAL_FLOOR).otherwise(F.lit(0.0))
    return issues.withColumn("penalty", F.round(F.least(F.greatest(cost, floor), ceiling), 2))


def grade(score: Column) -> Column:
    label = F.lit("Critical")
    for bound, name in reversed(GRADES):
        label = F.when(score >= bound, name).otherwise(label)
    return label


def health_issues(df: DataFrame, known: TableProfile | None = None, checks: Sequence[str] = CHECKS) -> DataFrame:
    """One row per issue, severest and widest first."""
    rows = issue_rows(df, known, checks)
    issues = with_penalty(df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA), len(df.columns))
    return ordered_issues(issues)


def ordered_issues(issues: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(rank, F.desc("pct_affected"), "id")


def health_score(issues: DataFrame, n_rows: int) -> DataFrame:
    """Score, grade and issue counts of an issue table (one row)."""
    total = F.coalesce(F.sum("penalty"), F.lit(0.0))
    score = F.lit(0.0) if not n_rows else F.round(F.greatest(F.lit(0.0), 100.0 - total), 1)
    return issues.agg(
        score.alias("score"),
        F.count("*").alias("n_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
        F.count_if(F.col("fix_action").isNotNull()).alias("n_fixable"),
    ).select("score", grade(F.col("score")).alias("grade"), "n_issues", *[f"n_{s}" for s in SEVERITIES], "n_fixable",
             F.lit(n_rows).cast("long").alias("n_rows"))


def passed_checks(issues: DataFrame, known: TableProfile | None = None) -> DataFrame:
    """The checks that found nothing. Spelling variants only pass where the profile shows
    that every text column has few enough values to be checked for them."""
    spark = issues.sparkSession
    unread = known is None or any(c["dtype"] == "string" and c["n_unique"] > MAX_VARIANT_VOCABULARY for c in known.columns)
    ran = spark.createDataFrame([(c,) for c in CHECKS if not (unread and c == "category_variants")], "check string")
    kinds = issues.select(F.when(F.col("kind") == "empty_column", "missing_values").otherwise(F.col("kind")).alias("check")).distinct()
    return ran.join(F.broadcast(kinds), "check", "left_anti")  # at most eleven kinds


def health(df: DataFrame, known: TableProfile | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, report): the audit and its one-row summary."""
    if known is None or known.facts is None or not _has_audit(known):
        known = profile_table(df, "sketch", audit=True)
    issues = health_issues(df, known)
    return issues, health_score(issues, known.n_rows)


def data_issue_findings(df: DataFrame, known: TableProfile | None = None, n_duplicates: int | None = None) -> DataFrame:
    """Gappy columns (20 % missing or more; ``columns`` names each with its share) and repeated rows, as findings.

    An audit has counted the repeated rows already and may pass them on.
    """
    known = known or profile_table(df, "sketch")
    rows = []
    gappy = [c for c in known.columns if c["null_pct"] >= MANY_NULLS_PCT]
    if gappy:
        gappy = sorted(gappy, key=lambda c: (-c["null_pct"], c["column"]))
        named = ", ".join(f"{c['column']} {c['null_pct']:.2f}" for c in gappy)
        rows.append(("blanks", gappy[0]["column"], float(gappy[0]["null_pct"]), len(gappy), 12.0, named))
    n = n_duplicates
    if n is None:
        n = duplicate_rows(df).first()["n_duplicates"] if known.n_rows else 0
    if n:
        rows.append(("duplicates", None, float(n), known.n_rows, 10.0, None))
    return df.sparkSession.createDataFrame(rows, "issue string, subject string, value double, n long, score double, columns string")


def empty_report(spark: SparkSession) -> DataFrame:
    return health_score(spark.createDataFrame([], ISSUE_SCHEMA).withColumn("penalty", F.lit(0.0)), 0)
