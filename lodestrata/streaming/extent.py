"""Extents of streams by event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.geometry import st_extent


def windowed_extent(stream: DataFrame, time: str, geometry: Column, width: str, late: str, by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """The extent of each window (and group): minima and maxima are the only state. ``late``: the watermark."""
    stamped = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    grouped = stamped.groupBy(F.window("_time", width, slide), *(by or []))
    found = grouped.agg(st_extent(geometry).alias("extent"))
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "extent.*")
