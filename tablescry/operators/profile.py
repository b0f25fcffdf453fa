"""Profile a table by meaning: one row per column, plus table-level flags."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescry.functions.names import LATITUDE_NAMES, LONGITUDE_NAMES, normalised_name
from tablescry.functions.scalars import is_date_type, is_numeric_type, is_text_type, present
from tablescry.operators.facts import DATE_SHARE, Facts, column_facts, text_facts
from tablescry.operators.value_counts import top_values, value_counts
from tablescry.session import cut_lineage

CATEGORY_MAX_DISTINCT = 20
CATEGORY_MAX_RATIO = 0.05
CATEGORY_RATIO_FROM_ROWS = 200
TOP_VALUES = 10
# Far above every limit below which an exact count decides something (400), so
# the sketch's few percent of error cannot hide a small vocabulary.
SMALL_VOCABULARY = 1000

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("semantic_type", T.StringType()),
        T.StructField("n_null", T.LongType()),
        T.StructField("null_pct", T.DoubleType()),
        T.StructField("n_unique", T.LongType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("min_date", T.StringType()),
        T.StructField("max_date", T.StringType()),
        T.StructField(
            "top_values",
            T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])),
        ),
    ]
)


@dataclass
class TableProfile:
    """The profile as the other operators read it; ``table`` gives it as rows."""

    n_rows: int
    columns: list[dict[str, Any]] = field(default_factory=list)
    facts: Facts | None = None
    counts: DataFrame | None = None  # value counts of the columns with a small vocabulary
    quantiles: dict[str, dict[float, float]] = field(default_factory=dict)  # exact, filled in as asked for

    def of_type(self, *kinds: str) -> list[str]:
        return [c["column"] for c in self.columns if c["semantic_type"] in kinds]

    def column(self, name: str) -> dict[str, Any]:
        return next(c for c in self.columns if c["column"] == name)

    def kind(self, name: str) -> str:
        return self.column(name)["semantic_type"]

    @property
    def has_datetime(self) -> bool:
        return bool(self.of_type("datetime"))

    @property
    def has_geo(self) -> bool:
        return bool(self.of_type("geo_lat")) and bool(self.of_type("geo_lon"))

    @property
    def n_numeric(self) -> int:
        return len(self.of_type("numeric"))

    def table(self, spark: SparkSession) -> DataFrame:
        names = PROFILE_SCHEMA.fieldNames()
        rows = [tuple(c.get(name) for name in names) for c in self.columns]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)


def is_category(n_unique: int, n_rows: int) -> bool:
    """A small repeated vocabulary; repetition is only judged from 200 rows on."""
    if n_rows == 0 or n_unique == 0 or n_unique > CATEGORY_MAX_DISTINCT:
        return False
    return n_rows < CATEGORY_RATIO_FROM_ROWS or n_unique / n_rows < CATEGORY_MAX_RATIO


def classify(name: str, data_type: T.DataType, facts: dict[str, Any], n_unique: int, n_rows: int) -> str:
    """Exactly one meaning per column: date, coordinate, category, number, text."""
    n_values = n_rows - facts["n_null"]
    numeric = is_numeric_type(data_type)
    if is_date_type(data_type):
        return "datetime"
    if not numeric and n_values and facts.get("n_dates", 0) / n_values >= DATE_SHARE:
        return "datetime"
    if numeric and facts["min"] is not None:
        plain = normalised_name(name)
        if plain in LATITUDE_NAMES and facts["min"] >= -90 and facts["max"] <= 90:
            return "geo_lat"
        if plain in LONGITUDE_NAMES and facts["min"] >= -180 and facts["max"] <= 180:
            return "geo_lon"
    if is_category(n_unique, n_rows):
        return "categorical"
    return "numeric" if numeric else "text"


def _exact_distinct(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Exact distinct counts, one column-pruned aggregate each, run as one job."""
    if not names:
        return {}
    parts = [
        df.select(present(F.col(f"`{name}`"), df.schema[name].dataType).alias("v"))
        .agg(F.count_distinct("v").alias("n_unique"))
        .select(F.lit(name).alias("column"), "n_unique")
        for name in names
    ]
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {row["column"]: row["n_unique"] for row in rows}


def profile_table(df: DataFrame, distinct: str = "exact", audit: bool = False) -> TableProfile:
    """Profile every column.

    ``distinct="exact"`` counts every column's values; ``"sketch"`` keeps the
    HyperLogLog estimate for columns with more than a thousand values, which
    never changes a classification and saves their shuffle.
    """
    facts = column_facts(df, audit=audit)
    small = [n for n, f in facts.columns.items() if f["approx_distinct"] <= SMALL_VOCABULARY]
    wide = [n for n in facts.columns if n not in set(small)]
    texts = [f.name for f in df.schema.fields if is_text_type(f.dataType)]

    counts = None
    n_unique: dict[str, int] = {name: 0 for name in small}
    tops: dict[str, list[tuple[str, int]]] = {}
    if small and facts.n_rows:
        counts = cut_lineage(value_counts(df, small))  # some thousand rows, read several times
        sizes = counts.groupBy("column").agg(F.count("*").alias("n_unique"))
        for row in top_values(counts, TOP_VALUES).join(sizes, "column").orderBy("column", "position").collect():
            n_unique[row["column"]] = row["n_unique"]
            tops.setdefault(row["column"], []).append((row["value"], row["n"]))
    n_values = {n: facts.n_rows - facts.columns[n]["n_null"] for n in texts}
    for name, found in text_facts(df, n_values, counts, audit).items():
        facts.columns[name] |= found
    if distinct == "exact":
        n_unique |= _exact_distinct(df, wide)
    else:
        n_unique |= {name: facts.columns[name]["approx_distinct"] for name in wide}

    result = TableProfile(n_rows=facts.n_rows, facts=facts, counts=counts)
    for ordinal, item in enumerate(df.schema.fields):
        if item.name not in facts.columns:
            continue
        known = facts.columns[item.name]
        kind = classify(item.name, item.dataType, known, n_unique[item.name], facts.n_rows)
        row: dict[str, Any] = {
            "ordinal": ordinal,
            "column": item.name,
            "dtype": item.dataType.simpleString(),
            "semantic_type": kind,
            "n_null": known["n_null"],
            "null_pct": round(100.0 * known["n_null"] / facts.n_rows, 2) if facts.n_rows else 0.0,
            "n_unique": n_unique[item.name],
        }
        if kind in ("numeric", "geo_lat", "geo_lon"):
            row |= {"min": known["min"], "max": known["max"], "mean": known["mean"]}
        elif kind == "datetime":
            first, last = known["min_date"], known["max_date"]
            row |= {"min_date": first and first.isoformat(), "max_date": last and last.isoformat()}
        elif kind == "categorical":
            row["top_values"] = tops.get(item.name, [])
        result.columns.append(row)
    return result


def profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per column: meaning, missing share, distinct values and statistics."""
    return profile_table(df, distinct).table(df.sparkSession)


def profile_flags(df: DataFrame, distinct: str = "sketch") -> DataFrame:
    """The table-level roll-up of a profile, as one row."""
    known = profile_table(df, distinct)
    return (
        known.table(df.sparkSession)
        .agg(
            F.count("*").alias("n_cols"),
            F.coalesce(F.bool_or(F.col("semantic_type") == "datetime"), F.lit(False)).alias("has_datetime"),
            (
                F.coalesce(F.bool_or(F.col("semantic_type") == "geo_lat"), F.lit(False))
                & F.coalesce(F.bool_or(F.col("semantic_type") == "geo_lon"), F.lit(False))
            ).alias("has_geo"),
            F.count_if(F.col("semantic_type") == "numeric").alias("n_numeric"),
        )
        .select(F.lit(known.n_rows).cast("long").alias("n_rows"), "*")
    )


def top_value_rows(profiled: DataFrame) -> DataFrame:
    """The profile's top values, one row per column and value."""
    return profiled.select("column", F.posexplode("top_values").alias("position", "entry")).select(
        "column", (F.col("position") + 1).alias("position"), "entry.value", F.col("entry.count").alias("n")
    )


def compact_profile(profiled: DataFrame, limit: int = 60) -> DataFrame:
    """Name, meaning, distinct values, missing share and three examples per column."""
    return (
        profiled.orderBy("ordinal")
        .limit(limit)
        .select(
            "column",
            "semantic_type",
            "n_unique",
            "null_pct",
            F.concat_ws("|", F.transform(F.slice("top_values", 1, 3), lambda v: v["value"])).alias("examples"),
        )
    )


def shape(profiled: DataFrame) -> DataFrame:
    """How many columns of each meaning the table has."""
    return profiled.groupBy("semantic_type").agg(F.count("*").alias("n_columns"))


def kind_counts(known: TableProfile) -> Counter:
    return Counter(c["semantic_type"] for c in known.columns)
