"""The value-count table: (column, value, n) for many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescry.functions.scalars import present, strip_ws


def as_text(df: DataFrame, name: str) -> Column:
    return present(F.col(f"`{name}`"), df.schema[name].dataType).cast("string")


def unpivoted(df: DataFrame, values: dict[str, Column], kept: dict[str, Column] | None = None, key: str = "column", value: str = "value") -> DataFrame:
    """A row for each of the named values of a row, whatever the names: (kept, key, value)."""
    kept, names = kept or {}, F.array(*map(F.lit, values))
    flat = df.select(*[c.alias(f"_k{i}") for i, c in enumerate(kept.values())], *[c.alias(f"_v{i}") for i, c in enumerate(values.values())])
    long = flat.unpivot([f"_k{i}" for i in range(len(kept))], [f"_v{i}" for i in range(len(values))], "_place", "_value")
    name = F.get(names, F.substring("_place", 3, 10).cast("int"))
    return long.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(kept)], name.alias(key), F.col("_value").alias(value))


def value_counts(df: DataFrame, columns: Sequence[str], strip: bool = False) -> DataFrame:
    """Counts of every non-null value of the named columns, as text.

    Counting is combined on the map side, so a value that fills a third of the
    table travels once per task. ``strip`` counts values without the white
    space around them.
    """
    wanted = [as_text(df, name) for name in columns]
    if strip:
        wanted = [strip_ws(value) for value in wanted]
    return (
        unpivoted(df, dict(zip(columns, wanted)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column; ties go to the smaller text."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def category_counts(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Frequency table of one column with the number of categories beside it.

    Top-k is planned as a bounded heap per task, so a column with any number of
    values can be asked.
    """
    counts = value_counts(df, [column])
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.select("value", "n", counts.agg(F.count("*")).scalar().alias("n_categories"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(present(F.col(f"`{column}`"), df.schema[column].dataType)).alias("n_unique"))
