"""Choose a table's shape and the role of its columns from the profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.functions.names import ID_NAME_AUDIT, ID_NAME_FINDINGS, is_identifier
from tablescry.functions.scalars import to_number
from tablescry.operators.value_counts import unpivoted
from tablescry.operators.profile import TableProfile, profile_table

ROUTING_SCHEMA = "archetype string, time_col string, entity_col string, target_col string, lat_col string, lon_col string"


@dataclass
class Routing:
    archetype: str
    time_col: str | None = None
    entity_col: str | None = None
    target_col: str | None = None
    lat_col: str | None = None
    lon_col: str | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], ROUTING_SCHEMA)


def pick_target(known: TableProfile) -> str | None:
    """First number that is not named like an identifier, else the first number."""
    numbers = known.of_type("numeric")
    return next((n for n in numbers if not is_identifier(n)), numbers[0] if numbers else None)


def route_profile(known: TableProfile) -> Routing:
    """Coordinates beat dates, dates beat plain tables."""

    def first(kind: str) -> str | None:
        return next(iter(known.of_type(kind)), None)

    if known.has_geo:
        archetype = "geo"
    elif known.has_datetime and known.n_numeric:
        archetype = "timeseries"
    else:
        archetype = "tabular"
    geo = archetype == "geo"
    return Routing(
        archetype=archetype,
        time_col=first("datetime"),
        entity_col=first("categorical"),
        target_col=pick_target(known),
        lat_col=first("geo_lat") if geo else None,
        lon_col=first("geo_lon") if geo else None,
    )


def route(df: DataFrame) -> DataFrame:
    return route_profile(profile_table(df, "sketch")).table(df.sparkSession)


def finding_measures(df: DataFrame, known: TableProfile, limit: int | None = None) -> list[str]:
    """Measures worth analysing, most varied first.

    Numbers and number-coded categories with at least three values of three
    kinds; spread is the standard deviation on the size of the mean.
    """
    ranked = []
    for c in known.columns:
        name = c["column"]
        facts = known.facts.columns[name]
        if c["semantic_type"] not in ("numeric", "categorical") or is_identifier(name, ID_NAME_FINDINGS):
            continue
        if facts.get("n_numbers", 0) < 3 or c["n_unique"] < 3 or facts.get("std") is None:
            continue
        if facts["min"] == facts["max"]:
            continue
        spread = facts["std"] / abs(facts["mean"]) if facts["mean"] else facts["std"]
        ranked.append((abs(spread), name))
    ranked.sort(reverse=True)
    return [name for _, name in ranked[:limit]]


def finding_categories(known: TableProfile) -> list[str]:
    return [
        c["column"]
        for c in known.columns
        if c["semantic_type"] == "categorical"
        and not is_identifier(c["column"], ID_NAME_FINDINGS)
        and 2 <= c["n_unique"] <= 20
    ]


def variation(facts: dict) -> float:
    """Coefficient of variation, bounded for a mean near zero."""
    if facts.get("n_numbers", 0) < 3 or not facts.get("std") or facts["std"] <= 0:
        return 0.0
    return facts["std"] / abs(facts["mean"]) if abs(facts["mean"]) > 1e-9 else 1.0


def chart_measures(known: TableProfile, target: str | None) -> list[str]:
    """Numbers that are no identifiers, most varied first, the target leading."""
    numbers = [n for n in known.of_type("numeric") if not is_identifier(n, ID_NAME_AUDIT)]
    ranked = sorted(numbers, key=lambda n: variation(known.facts.columns[n]), reverse=True)
    if target in ranked:
        ranked.remove(target)
        ranked.insert(0, target)
    return ranked


def chart_categories(known: TableProfile, limit: int = 50) -> list[str]:
    return [c for c in known.of_type("categorical") if known.column(c)["n_unique"] <= limit]


def measure_ranking(df: DataFrame) -> DataFrame:
    """Every chartable measure with its coefficient of variation and place."""
    known = profile_table(df, "sketch")
    names = chart_measures(known, route_profile(known).target_col)
    rows = [(i + 1, n, float(variation(known.facts.columns[n]))) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "position int, measure string, variation double")


def category_spread(df: DataFrame, categories: list[str], measure: str) -> DataFrame:
    """How unevenly each category splits a measure: spread of its group means
    relative to the overall mean. One scan for all categories."""
    value = to_number(F.col(f"`{measure}`"), df.schema[measure].dataType)
    stacked = (
        unpivoted(df, {c: F.col(f"`{c}`").cast("string") for c in categories}, {"_v": value}, "category")
        .where(F.col("_v").isNotNull())
    )
    groups = stacked.groupBy("category", "value").agg(F.avg("_v").alias("mean"), F.sum("_v").alias("total"), F.count("*").alias("n"))
    overall = groups.groupBy("category").agg(
        (F.sum("total") / F.sum("n")).alias("overall"),
        F.stddev_samp(F.when(F.col("value").isNotNull(), F.col("mean"))).alias("between"),
        F.count("value").alias("n_groups"),
    )
    return overall.where((F.col("n_groups") >= 2) & (F.col("overall") != 0)).select(
        "category", "n_groups", (F.col("between") / F.abs("overall")).alias("spread")
    )


def best_category(df: DataFrame, categories: list[str], measure: str) -> str | None:
    """The category whose group means differ most."""
    if not categories:
        return None
    place = {name: i for i, name in enumerate(categories)}
    rows = category_spread(df, categories, measure).where("spread is not null").collect()
    if not rows:
        return categories[0]
    return min(rows, key=lambda r: (-r["spread"], place[r["category"]]))["category"]
