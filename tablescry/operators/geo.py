"""Points on a map: placeable rows, the view that holds them, the busiest cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescry.operators.aggregates import in_time_range, number_of

DEFAULT_ZOOM, MIN_ZOOM, MAX_ZOOM, ZOOM_PADDING = 10.0, 0.0, 16.0, 0.4
MIN_MARKER, MAX_MARKER = 5.0, 26.0
CELL_DEGREES = 0.1


def placeable(df: DataFrame, lat: str, lon: str, measure: str, keep: list[str] | None = None) -> DataFrame:
    """Rows with both coordinates and a measure, as lat, lon, value (+ kept columns)."""
    return df.select(
        *[F.col(f"`{c}`") for c in keep or []],
        number_of(df, lat).alias("lat"), number_of(df, lon).alias("lon"), number_of(df, measure).alias("value"),
    ).where("lat is not null and lon is not null and value is not null")


def map_points(df: DataFrame, lat: str, lon: str, measure: str, keep: list[str] | None = None) -> DataFrame:
    """Placeable rows with a marker size scaled to the measure; midway when it is constant."""
    points = placeable(df, lat, lon, measure, keep)
    ends = points.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    share = (F.col("value") - ends["lo"]) / F.nullif(ends["hi"] - ends["lo"], F.lit(0.0))
    size = F.coalesce(MIN_MARKER + (MAX_MARKER - MIN_MARKER) * share, F.lit((MIN_MARKER + MAX_MARKER) / 2))
    return points.withColumn("marker_size", size)


def map_view(df: DataFrame, lat: str, lon: str, measure: str) -> DataFrame:
    """Centre and zoom that hold every point; zoom 10 when they share one spot."""
    points = placeable(df, lat, lon, measure)
    box = points.agg(
        F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"),
        (F.max("lat") - F.min("lat")).alias("_h"), (F.max("lon") - F.min("lon")).alias("_w"),
    )
    fit = F.least(
        F.when(F.col("_w") > 0, F.log2(360.0 / F.col("_w"))),
        F.when(F.col("_h") > 0, F.log2(180.0 / F.col("_h"))),
    )
    fitted = F.greatest(F.lit(MIN_ZOOM), F.least(F.lit(MAX_ZOOM), fit - ZOOM_PADDING))
    zoom = F.when(fit.isNotNull(), fitted).otherwise(F.lit(DEFAULT_ZOOM))
    return box.where("centre_lat is not null").select("centre_lat", "centre_lon", F.round(zoom, 2).alias("zoom"))


def densest_cell(df: DataFrame, lat: str, lon: str, measure: str) -> DataFrame:
    """The 0.1 degree cell with most points; no row unless it holds at least two."""
    cell = placeable(df, lat, lon, measure).select(
        F.rint(F.col("lat") / CELL_DEGREES).cast("long").alias("i"), F.rint(F.col("lon") / CELL_DEGREES).cast("long").alias("j")
    )
    return (
        cell.groupBy("i", "j").agg(F.count("*").alias("n_points"))
        .where("n_points >= 2")
        .orderBy(F.desc("n_points"), "i", "j")
        .limit(1)
        .select(F.round(F.col("i") * CELL_DEGREES, 4).alias("lat"), F.round(F.col("j") * CELL_DEGREES, 4).alias("lon"), "n_points")
    )


def geo_stats(df: DataFrame, lat: str, lon: str, measure: str) -> DataFrame:
    """Bounds, dropped rows and the measure's range, in one aggregate."""
    la, lo, v = number_of(df, lat), number_of(df, lon), number_of(df, measure)
    ok = la.isNotNull() & lo.isNotNull() & v.isNotNull()
    at = {"lat": F.when(ok, la), "lon": F.when(ok, lo), "value": F.when(ok, v)}
    return df.agg(
        F.count_if(ok).alias("n_points"),
        F.count_if(~ok).alias("n_dropped"),
        F.count_if(la.isNull() | lo.isNull()).alias("n_without_coordinate"),
        F.min(at["lat"]).alias("lat_min"), F.max(at["lat"]).alias("lat_max"),
        F.min(at["lon"]).alias("lon_min"), F.max(at["lon"]).alias("lon_max"),
        F.min(at["value"]).alias("value_min"), F.max(at["value"]).alias("value_max"), F.avg(at["value"]).alias("value_mean"),
    )


def in_window(df: DataFrame, time: str | None, window: tuple | None) -> DataFrame:
    return in_time_range(df, time, *window) if window and time else df
