"""Per-column facts of a table, which later plans are shaped by.

One global aggregate over one scan for all columns, and one more question to
text columns about what their values could be read as. Partial states have a
fixed size, and what comes to the driver is one row per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.functions.scalars import (
    MAX_MARKER_LENGTH,
    is_analysable,
    is_date_type,
    is_missing_word,
    is_numeric_type,
    begins_like_a_date,
    parse_number,
    parse_stamp,
    present,
    strip_ws,
    to_number,
)


DATE_SHARE = 0.80


@dataclass
class Facts:
    """What one scan learned: table row count and a dict of facts per column."""

    n_rows: int
    columns: dict[str, dict[str, Any]] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def _aggregates(name: str, data_type: T.DataType, audit: bool) -> dict[str, Column]:
    """What every column is asked; text is looked into separately."""
    c = F.col(f"`{name}`")
    value = present(c, data_type)
    wanted: dict[str, Column] = {
        "n_null": F.count_if(value.isNull()),
        "approx_distinct": F.approx_count_distinct(value, 0.05),
    }
    if audit:
        wanted["fingerprint"] = F.sum(F.xxhash64(value).cast("decimal(20,0)"))
    if is_numeric_type(data_type):
        number = to_number(c, data_type)
        wanted |= {
            "n_numbers": F.count(number),
            "min": F.min(number),
            "max": F.max(number),
            "mean": F.avg(number),
            "std": F.stddev_samp(number),
        }
    elif is_date_type(data_type):
        stamp = c.cast("timestamp_ntz")
        wanted |= {"n_dates": F.count(stamp), "min_date": F.min(stamp), "max_date": F.max(stamp)}
    return wanted


def column_facts(df: DataFrame, audit: bool = False) -> Facts:
    """Count, distinct estimate, range and spread of every column, in one scan."""
    plan: list[tuple[str, str, Column]] = []
    skipped = []
    for item in df.schema.fields:
        if not is_analysable(item.dataType):
            skipped.append(item.name)
            continue
        for fact, expression in _aggregates(item.name, item.dataType, audit).items():
            plan.append((item.name, fact, expression))
    row = df.agg(
        F.count("*").alias("n_rows"),
        *[expression.alias(f"f{i}") for i, (_, _, expression) in enumerate(plan)],
    ).first()
    facts = Facts(n_rows=row["n_rows"], skipped=skipped)
    for i, (name, fact, _) in enumerate(plan):
        facts.columns.setdefault(name, {})[fact] = row[f"f{i}"]
    return facts


def _text_questions(audit: bool) -> dict[str, Column]:
    """Aggregates over (value, n): a value that stands for n equal rows."""
    n, number = F.col("n"), F.col("number")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    count = F.sum(F.when(number.isNotNull(), n))
    wanted = {
        "n_date_like": rows_where(begins_like_a_date(F.col("text"))),
        "n_numbers": rows_where(number.isNotNull()),
        "min": F.min(number),
        "max": F.max(number),
        "mean": F.try_divide(F.sum(number * n), count),
    }
    if audit:
        text = F.col("text")
        head = F.left(text, F.lit(MAX_MARKER_LENGTH))
        tail = F.reverse(F.right(text, F.lit(MAX_MARKER_LENGTH)))
        wanted |= {
            "n_words_for_missing": rows_where(is_missing_word(text)),
            "n_untidy": rows_where(F.col("value") != text),
            "n_bare_numbers": rows_where(F.col("bare").isNotNull()),
            "n_with_digit": rows_where(text.rlike("[0-9]")),
            "shortest": F.min(F.length(text)),
            "head_min": F.min(head),
            "head_max": F.max(head),
            "tail_min": F.min(tail),
            "tail_max": F.max(tail),
        }
    return wanted


def _readings(values: DataFrame, audit: bool) -> DataFrame:
    """What a text value could also be read as, worked out once per value."""
    text = strip_ws(F.col("value"))
    readings = {"text": text, "number": parse_number(text)}
    if audit:
        readings["bare"] = parse_number(F.regexp_replace(text, r"(?U)[,\s]", ""))
    return values.withColumns(readings)


def _spread_questions(means: dict[str, float]) -> dict[str, Column]:
    """Standard deviation around means that are known, so nothing cancels."""
    mean = F.coalesce(*[F.when(F.col("column") == c, F.lit(m)) for c, m in means.items()])
    count = F.sum(F.when(F.col("number").isNotNull(), F.col("n")))
    return {"std": F.when(count > 1, F.sqrt(F.try_divide(F.sum(F.pow(F.col("number") - mean, 2) * F.col("n")), count - 1)))}


def _date_questions() -> dict[str, Column]:
    plausible = F.year("stamp").between(1900, 2100)
    return {
        "n_dates": F.coalesce(F.sum(F.when(plausible, F.col("n"))), F.lit(0)),
        "min_date": F.min("stamp"),
        "max_date": F.max("stamp"),
    }


def _ask(df: DataFrame, columns: list[str], counts: DataFrame | None, questions: dict[str, Column], readings) -> dict[str, dict[str, Any]]:
    """Put questions about (value, n) to text columns.

    Columns of a small vocabulary are judged on their value counts, so a value
    is parsed once however often it occurs. The others are scanned row by row,
    one aggregate per column over just that column.
    """
    found: dict[str, dict[str, Any]] = {}
    wanted = [e.alias(k) for k, e in questions.items()]
    if counts is not None and columns:
        asked = readings(counts.where(F.col("column").isin(*columns))).groupBy("column").agg(*wanted)
        found = {row["column"]: {k: row[k] for k in questions} for row in asked.collect()}
    parts = []
    for name in columns:
        if name not in found:
            values = df.select(F.lit(name).alias("column"), F.col(f"`{name}`").alias("value"), F.lit(1).cast("long").alias("n")).where("value is not null")
            parts.append(readings(values).agg(*wanted).select(F.lit(name).alias("column"), "*"))
    if parts:
        for row in reduce(DataFrame.unionByName, parts).collect():
            found[row["column"]] = {k: row[k] for k in questions}
    return found


def text_facts(df: DataFrame, columns: dict[str, int], counts: DataFrame | None, audit: bool = False) -> dict[str, dict[str, Any]]:
    """Dates, numbers and untidiness in text columns, given their value counts.

    Dates are parsed only in columns where four values in five begin like one;
    no other column can pass for a date column.
    """
    found = _ask(df, list(columns), counts, _text_questions(audit), lambda v: _readings(v, audit))
    likely = [c for c, n_values in columns.items() if n_values and found[c]["n_date_like"] >= DATE_SHARE * n_values]
    dated = _ask(df, likely, counts, _date_questions(), lambda v: v.withColumn("stamp", parse_stamp(F.col("value"))))
    means = {c: float(found[c]["mean"]) for c in columns if (found[c]["n_numbers"] or 0) > 1}
    spread = _ask(df, list(means), counts, _spread_questions(means), lambda v: v.withColumn("number", parse_number(strip_ws(F.col("value"))))) if means else {}
    none = {"n_dates": 0, "min_date": None, "max_date": None, "std": None}
    return {c: none | found[c] | dated.get(c, {}) | spread.get(c, {}) for c in columns}
