"""Rules that read a column's *name*: resolution, identifiers, summability."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that mark identifiers, per pass.
ID_NAME = r"(?i)(^id$|_id$|^id_|^index$|_key$|_no$|number$)"
ID_NAME_AUDIT = r"(?i)(^id$|_id$|^id_|^index$|_key$|_no$|number$|^unnamed)"
ID_NAME_FINDINGS = r"(?i)(^id$|_id$|^id_|^index$|_key$|_no$|number$|_code$)"

# Names of measures that may be summed.
ACCUMULATING_NAME = (
    r"(?i)(revenue|sales|amount|total|count|qty|quantity|units|spend|cost|profit|"
    r"income|volume|orders|clicks|views|visits)"
)

# Coordinate column names.
LATITUDE_NAMES = ("lat", "latitude", "lat_deg", "y_lat")
LONGITUDE_NAMES = ("lon", "lng", "long", "longitude", "lon_deg", "x_lon")

# Plausible range by column name, first match wins.
PLAUSIBLE_RANGES = (
    (r"(^|_)age($|_)", 0.0, 130.0),
    (r"(pct|percent|percentage|_rate)($|_)", -100.0, 100.0),
    (r"(^|_)(qty|quantity|count|units|stock)($|_)", 0.0, None),
    (r"(price|amount|revenue|sales|cost|salary|income)($|_)", 0.0, None),
)

# Accepted spellings of the six aggregates.
AGGREGATES = ("sum", "mean", "median", "count", "min", "max")
AGGREGATE_SYNONYMS = {
    "avg": "mean",
    "average": "mean",
    "total": "sum",
    "largest": "max",
    "smallest": "min",
    "highest": "max",
    "lowest": "min",
}


class ColumnNotFound(ValueError):
    """Names the column that was asked for and does not exist."""


class NotCalculable(ValueError):
    """A request whose arguments cannot be calculated; the message says why."""


def resolve_column(df: DataFrame, name: str | None, role: str = "the column") -> str:
    """Exact match first, then case-insensitive; otherwise an error naming the column."""
    wanted = "" if name is None else str(name).strip()
    if not wanted:
        raise ColumnNotFound(f"a column is needed for {role} and none was given")
    if wanted in df.columns:
        return wanted
    for candidate in df.columns:
        if candidate.lower() == wanted.lower():
            return candidate
    raise ColumnNotFound(f"there is no column called {wanted!r} for {role}")


def is_identifier(name: str, pattern: str = ID_NAME) -> bool:
    return re.search(pattern, str(name)) is not None


def accumulates(name: str) -> bool:
    return re.search(ACCUMULATING_NAME, str(name)) is not None


def default_aggregate(name: str) -> str:
    return "sum" if accumulates(name) else "mean"


def plausible_range(name: str) -> tuple[float | None, float | None] | None:
    """Bounds implied by the first rule whose pattern the name matches."""
    for pattern, low, high in PLAUSIBLE_RANGES:
        if re.search(pattern, str(name).lower()):
            return low, high
    return None


def columns_of(names: Iterable[str]) -> list[Column]:
    """The columns of these names, dots and all."""
    return [F.col(f"`{name}`") for name in names]


def normalised_name(name: str) -> str:
    return re.sub(r"[ -]", "_", str(name).strip().lower())


def aggregate_name(value: str | None, default: str = "mean") -> str:
    wanted = str(value or default).strip().lower()
    wanted = AGGREGATE_SYNONYMS.get(wanted, wanted)
    if wanted not in AGGREGATES:
        raise NotCalculable(f"{wanted!r} is not one of {', '.join(AGGREGATES)}")
    return wanted


def aggregate_column(value: Column, agg: str) -> Column:
    """The Spark aggregate for every name but the median.

    An exact median is a distributed selection, not a single-task aggregate;
    see ``operators.quantiles``.
    """
    builders = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
    return builders[agg](value)
