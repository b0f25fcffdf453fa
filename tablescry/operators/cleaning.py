"""Repairs as lazy transformations, and a receipt of what they changed.

Every repair marks what it changes in hidden columns. The cleaned table drops
the marks; the receipt is one aggregate over them. Nothing is applied to the
original, which stays readable and is the way back.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.functions.names import NotCalculable, columns_of, resolve_column
from tablescry.functions.scalars import as_ordinal, is_missing_word, is_numeric_type, is_text_type, present, strip_ws, undecorated_number
from tablescry.operators.aggregates import number_of, outside
from tablescry.operators.profile import profile_table
from tablescry.operators.quality import fences, number_markers
from tablescry.operators.quantiles import exact_quantiles

# The order repairs run in, whatever order they arrive in.
APPLY_ORDER = (
    "trim_whitespace", "merge_categories", "to_numeric", "drop_column",
    "drop_invalid", "cap_outliers", "drop_duplicates", "fill_missing",
)
STRATEGIES = ("median", "mean", "zero", "forward", "drop", "label")
CHUNKS, CHUNK_ROWS = 1000, 1_000_000

RECEIPT_SCHEMA = "step int, action string, column string, rows_before long, rows_after long, cells_changed long, cells_lost long"


class CleanError(NotCalculable):
    """A repair that cannot run; nothing is applied when one is raised."""


def plan_clean(issues: DataFrame, approved: Sequence[str] | None = None) -> list[dict[str, Any]]:
    """Turn issues into ordered steps. ``None`` approves every fix, ``[]`` none."""
    wanted = issues.where("fix_action is not null")
    if approved is not None:
        wanted = wanted.where(F.col("id").isin(list(approved))) if approved else wanted.limit(0)
    steps = []
    for row in wanted.select("id", "fix_action", "fix_column", "fix_params").collect():  # a few per column
        params = {k: _read(v) for k, v in (row["fix_params"] or {}).items()}
        steps.append({"issue_id": row["id"], "action": row["fix_action"], "column": row["fix_column"], **params})
    return in_order(steps)


def _read(value: str) -> Any:
    try:
        return json.loads(value)
    except ValueError:
        return value


def in_order(steps: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
    for step in steps:
        if step.get("action") not in APPLY_ORDER:
            raise CleanError(f"{step.get('action')!r} is not a repair; available: {', '.join(APPLY_ORDER)}")
    return sorted(steps, key=lambda s: (APPLY_ORDER.index(s["action"]), str(s.get("column"))))


# ------------------------------------------------------------ single repairs --
def drop_duplicates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """First copy of every row.

    With ``order_by`` (a row id that is not part of the comparison) the smallest
    id survives. The rows themselves are the grouping key, so copies are folded
    within each task before anything is shuffled and no group is ever gathered.
    """
    if order_by is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != order_by]
    kept = df.groupBy(*[F.col(f"`{c}`") for c in others]).agg(F.min(F.col(f"`{order_by}`")).alias(order_by))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def merge_mapping(df: DataFrame, column: str, mapping: dict[str, str]) -> tuple[Column, Column]:
    """(new value, changed) for an approved spelling map of at most 400 entries."""
    text = strip_ws(F.col(f"`{column}`"))
    pairs = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return F.coalesce(F.element_at(pairs, text), text), F.coalesce(text.isin(list(mapping)), F.lit(False))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def without_missing_words(df: DataFrame, column: str) -> Column:
    data_type = df.schema[column].dataType
    c = present(F.col(f"`{column}`"), data_type)
    return F.when(~is_missing_word(c), c) if is_text_type(data_type) else c


def forward_fill(df: DataFrame, column: str, order_by: str, keys: Sequence[str] = (), ties: Sequence[str] | None = None) -> DataFrame:
    """Last known value carried down, then the first known one carried up.

    Rows are in a total order: by the order column, nulls first, and rows of one order
    value by the MD5 of their ``ties`` columns (all that read as text, unless named). The
    table is cut into ranges of that order, about a million rows each: the order column
    is cut at its quantiles, and a value that holds a range or more, or null, is a range of
    its own, cut by the MD5. Each range reports its last and first known value (one row
    per range), those rows are carried across ranges, and every range then fills itself,
    so no task sees more than one range however long the table is and however many rows
    share an order value.
    """
    c, o = F.col(f"`{column}`"), F.col(f"`{order_by}`")
    as_number = as_ordinal(o, df.schema[order_by].dataType)
    ends = df.select(as_number.alias("o")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o").isNull()).alias("n_null"), F.min("o").alias("lo"), F.max("o").alias("hi"),
        F.percentile_approx("o", [i / CHUNKS for i in range(1, CHUNKS)], 10 * CHUNKS).alias("splits"),
    ).first()
    splits, lo, hi = Counter(ends["splits"] or []), ends["lo"], ends["hi"]
    common = {e for e, n in splits.items() if n > 1}  # a value that fills a range is a range of its own
    edges = sorted({e for e in splits if lo < e <= hi} | {float(np.nextafter(e, np.inf)) for e in common if e < hi})
    named = ties if ties is not None else [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    tie = F.md5(F.concat_ws("|", *(F.coalesce(F.col(f"`{t}`").cast("string"), F.lit("")) for t in named)).cast("binary"))
    ordered = df.withColumns({"_o": as_number, "_tie": tie})
    if edges:
        ordered = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_o", outputCol="_bucket", handleInvalid="keep").transform(ordered)
        ordered = ordered.withColumn("_chunk", F.coalesce(F.col("_bucket"), F.lit(-1.0))).drop("_bucket")
    else:
        ordered = ordered.withColumn("_chunk", F.when(F.col("_o").isNull(), -1.0).otherwise(0.0))
    bounds = [lo or 0.0, *edges, hi or 0.0]
    rows_of = [(splits[v] + 1) * ends["n"] / CHUNKS if v in common or lo == hi else 0 for v in bounds[:-1]]  # of chunks with one value only
    at, limits = F.col("_chunk").cast("int"), F.array(*[F.lit(float(e)) for e in bounds])
    low, high, pieces = F.get(limits, at), F.get(limits, at + 1), F.get(F.array(*[F.lit(math.ceil(n / CHUNK_ROWS)) for n in rows_of]), at)
    parts = math.ceil(ends["n"] / (CHUNKS * CHUNK_ROWS))
    linear = F.coalesce(F.least(F.floor((F.col("_o") - low) / F.nullif(high - low, F.lit(0.0)) * parts), F.lit(parts - 1)), F.lit(0))
    by_tie = F.conv(F.substring("_tie", 1, 8), 16, 10).cast("double") / float(1 << 32)
    of_null = F.floor(by_tie * math.ceil(ends["n_null"] / CHUNK_ROWS))
    part = F.when(F.col("_o").isNull(), of_null).when(pieces > 0, F.floor(by_tie * pieces)).otherwise(linear)
    ordered = ordered.withColumn("_part", part.cast("int"))
    place = ["_chunk", "_part"]
    known = F.when(c.isNotNull(), F.struct(o.alias("o"), F.col("_tie").alias("tie"), c.alias("v")))
    reported = ordered.groupBy(*columns_of(keys), *place).agg(F.max(known)["v"].alias("_last"), F.min(known)["v"].alias("_first"))
    along = Window.partitionBy(*(columns_of(keys) or [F.lit(1)])).orderBy(*place)  # a row per range
    back = Window.partitionBy(*(columns_of(keys) or [F.lit(1)])).orderBy(*[F.desc(p) for p in place])
    carried = reported.select(
        *columns_of(keys), *place, F.col("_first").alias("_own"),
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
        F.last("_first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
    )
    within = Window.partitionBy(*columns_of(keys), *place).orderBy(o, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    # Only rows before the first known value of all are left to fill from below.
    filled = F.coalesce(F.last(c, ignorenulls=True).over(within), "_above", "_own", "_below")
    # Null keys are a group too, so they must meet in the join.
    renamed = carried.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate([*keys, *place])})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate([*keys, *place])]
    return ordered.join(renamed, same).withColumn("_filled", filled).select(
        *[F.col("_filled").alias(x) if x == column else F.col(f"`{x}`") for x in df.columns]
    )


# ------------------------------------------------------------------ the fold --
class _Cleaning:
    """The working frame with its marks; ``closed`` holds finished receipts."""

    def __init__(self, df: DataFrame, order_by: str | None):
        self.frame = df
        self.order_by = order_by
        self.visible = list(df.columns)
        self.alive = F.lit(True)
        self.open: list[tuple[int, str, str | None, Column, Column, Column]] = []
        self.closed: list[DataFrame] = []
        self.removed: set[str] = set()

    def replace(self, step: int, action: str, column: str, value: Column, changed: Column, lost: Column | None = None) -> None:
        mark, gone = f"_changed_{step}", f"_lost_{step}"
        marks = {mark: F.coalesce(changed, F.lit(False)), gone: F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))}
        self.frame = self.frame.withColumns(marks | {column: value})
        self.open.append((step, action, column, self.alive, self.alive, F.col(mark), F.col(gone)))

    def remove_rows(self, step: int, action: str, column: str, bad: Column) -> None:
        mark = f"_removed_{step}"
        self.frame = self.frame.withColumn(mark, F.coalesce(bad, F.lit(False)))
        before, self.alive = self.alive, self.alive & ~F.col(mark)
        self.open.append((step, action, column, before, self.alive, F.lit(False), F.lit(False)))

    def living(self) -> DataFrame:
        return self.frame.where(self.alive).select(*[F.col(f"`{c}`") for c in self.visible])

    def close(self) -> None:
        """Count the open steps in one aggregate and start again without marks."""
        if self.open:
            wanted = []
            for step, action, column, before, after, changed, lost in self.open:
                wanted.append(
                    F.struct(
                        F.lit(step).alias("step"), F.lit(action).alias("action"), F.lit(column).cast("string").alias("column"),
                        F.count_if(before).alias("rows_before"), F.count_if(after).alias("rows_after"),
                        F.count_if(before & changed).alias("cells_changed"), F.count_if(before & lost).alias("cells_lost"),
                    ).alias(f"s{step}")
                )
            names = [f"s{step}" for step, *_ in self.open]
            self.closed.append(
                self.frame.agg(*wanted).select(F.explode(F.array(*[F.col(n) for n in names])).alias("r")).select("r.*")
            )
        self.frame, self.alive, self.open = self.living(), F.lit(True), []


def clean(df: DataFrame, steps: Sequence[dict[str, Any]], order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, receipt) for a list of ``{action, column, ...}`` steps.

    All steps are checked before any is planned. Both results are lazy, but planning reads
    the table for what a step needs to know: markers of a number column, fences, means and
    medians. A step on a column that an earlier step drops is left out of the receipt.
    Values that a number conversion can't read become null and are counted as lost.
    """
    work = _Cleaning(df, order_by)
    for number, step in enumerate(in_order(steps)):
        action = step["action"]
        if action == "drop_duplicates":
            _drop_duplicates_step(work, number)
            continue
        wanted = step.get("column")
        if wanted in work.removed:
            continue
        column = resolve_column(work.living(), wanted, action)
        _STEPS[action](work, number, column, step)
    work.close()
    receipt = df.sparkSession.createDataFrame([], RECEIPT_SCHEMA)
    for part in work.closed:
        receipt = receipt.unionByName(part)
    return work.frame, receipt.orderBy("step")


def _trim(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    if not is_text_type(work.frame.schema[column].dataType):
        raise CleanError(f"`{column}` is not text, so it has no white space to trim")
    text = F.col(f"`{column}`")
    work.replace(number, "trim_whitespace", column, strip_ws(text), text != strip_ws(text))


def _merge(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    mapping = step.get("mapping") or {}
    if not mapping:
        raise CleanError(f"no spellings to merge were given for `{column}`")
    value, changed = merge_mapping(work.frame, column, mapping)
    work.replace(number, "merge_categories", column, value, changed)


def _to_numeric(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    if is_numeric_type(work.frame.schema[column].dataType):
        work.replace(number, "to_numeric", column, F.col(f"`{column}`"), F.lit(False))
        return
    markers = number_markers(profile_table(work.living().select(F.col(f"`{column}`")), "sketch", audit=True), column)
    value = undecorated_number(F.col(f"`{column}`"), *markers)
    if work.living().where(value.isNotNull()).isEmpty():
        raise CleanError(f"nothing in `{column}` reads as a number")
    present = F.col(f"`{column}`").isNotNull()
    work.replace(number, "to_numeric", column, value, value.isNotNull(), present & value.isNull())


def _drop_column(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    if len(work.visible) <= 1:
        raise CleanError(f"`{column}` is the only column left")
    work.visible.remove(column)
    work.removed.add(column)
    work.open.append((number, "drop_column", column, work.alive, work.alive, F.lit(True), F.lit(False)))


def _drop_invalid(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    low, high = step.get("low"), step.get("high")
    if low is None and high is None:
        raise CleanError(f"no bounds were given for `{column}`")
    work.remove_rows(number, "drop_invalid", column, outside(number_of(work.frame, column), low, high))


def _cap(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    low, high = step.get("low"), step.get("high")
    if low is None or high is None:
        living = work.living().select(F.col(f"`{column}`"))
        bounds = fences(living, [column], profile_table(living, "sketch")).get(column)
        if bounds is None:
            raise CleanError(f"`{column}` has too little spread for a fence")
        low, high = bounds["low"], bounds["high"]
    value = number_of(work.frame, column)
    work.replace(number, "cap_outliers", column, clipped(value, float(low), float(high)), outside(value, low, high))


def _drop_duplicates_step(work: _Cleaning, number: int) -> None:
    work.close()
    before = work.frame
    after = drop_duplicates(before, work.order_by)
    counts = before.agg(F.count("*").alias("rows_before")).withColumn("rows_after", after.agg(F.count("*")).scalar())
    work.closed.append(counts.select(
        F.lit(number).alias("step"), F.lit("drop_duplicates").alias("action"), F.lit(None).cast("string").alias("column"),
        "rows_before", "rows_after", *(F.lit(0).cast("long").alias(c) for c in ("cells_changed", "cells_lost")),
    ))
    work.frame = after


def _fill(work: _Cleaning, number: int, column: str, step: dict[str, Any]) -> None:
    strategy = str(step.get("strategy") or "").lower()
    data_type = work.frame.schema[column].dataType
    if strategy not in STRATEGIES:
        raise CleanError(f"{strategy!r} is not a way of filling gaps; available: {', '.join(STRATEGIES)}")
    if strategy == "label" and is_numeric_type(data_type):
        strategy = "median"  # the column became a number in an earlier step
    gapped = without_missing_words(work.frame, column)
    if strategy == "drop":
        work.remove_rows(number, "fill_missing", column, gapped.isNull())
        return
    if strategy == "label":
        work.replace(number, "fill_missing", column, F.coalesce(gapped.cast("string"), F.lit(str(step.get("value") or "Unknown"))), gapped.isNull())
        return
    living = work.living()
    numbers = living.select(number_of(living, column).alias("v")).where("v is not null")
    if strategy == "forward":
        if not work.order_by:
            raise CleanError("a forward fill needs an order column")
        work.close()
        ready = work.frame.withColumn(f"_gap_{number}", without_missing_words(work.frame, column).isNull())
        ready = ready.withColumn(column, number_of(work.frame, column))
        filled = forward_fill(ready, column, work.order_by)
        work.frame = filled
        work.open.append((number, "fill_missing", column, F.lit(True), F.lit(True), F.col(f"_gap_{number}"), F.lit(False)))
        return
    if strategy == "zero":
        fill: float | None = 0.0
    elif strategy == "mean":
        fill = numbers.agg(F.avg("v").alias("m")).first()["m"]
    else:
        row = exact_quantiles(numbers, [], [0.5]).first()
        fill = row["q"] if row else None
    if fill is None:
        raise CleanError(f"`{column}` has no numbers to fill its gaps from")
    value = number_of(work.frame, column)
    work.replace(number, "fill_missing", column, F.coalesce(value, F.lit(float(fill))), gapped.isNull())


_STEPS = {
    "trim_whitespace": _trim,
    "merge_categories": _merge,
    "to_numeric": _to_numeric,
    "drop_column": _drop_column,
    "drop_invalid": _drop_invalid,
    "cap_outliers": _cap,
    "fill_missing": _fill,
}


def receipt_totals(receipt: DataFrame) -> DataFrame:
    """Steps run, rows removed and cells changed over a whole receipt."""
    return receipt.agg(
        F.count("*").alias("n_steps"),
        F.coalesce(F.sum(F.col("rows_before") - F.col("rows_after")), F.lit(0)).alias("rows_removed"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells_changed", "cells_lost")),
    )
