"""Relational uses of the extent: by group, under a condition, over windows, with subtotals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from lodestrata.functions.geometry import extent_of, st_bounds

SIDES = ("xmin", "ymin", "xmax", "ymax")


def _bounded(df: DataFrame, geometry: Column, by: list[str], where: Column | None = None) -> DataFrame:
    """``by`` and the bounds of each row, worked out once, before the aggregate takes the four sides."""
    bounds = st_bounds(geometry) if where is None else F.when(where, st_bounds(geometry))
    return df.select(*by, bounds.alias("_b")).select(*by, *(F.col("_b")[s].alias(f"_{s}") for s in SIDES))


def _extent() -> Column:
    return extent_of(F.struct(*(F.col(f"_{s}").alias(s) for s in SIDES))).alias("_e")


def extent(df: DataFrame, geometry: Column, by: list[str] | None = None) -> DataFrame:
    """The extent of all rows, or of each group, as four columns."""
    by = by or []
    return _bounded(df, geometry, by).groupBy(*by).agg(_extent()).select(*by, "_e.*")


def extent_where(df: DataFrame, geometry: Column, where: Column, by: list[str] | None = None) -> DataFrame:
    """As ``extent``, of the rows that hold ``where``; groups without such a row stay."""
    by = by or []
    return _bounded(df, geometry, by, where).groupBy(*by).agg(_extent()).select(*by, "_e.*")


def extent_over(df: DataFrame, geometry: Column, window: WindowSpec) -> DataFrame:
    """``df`` with the extent over a window, as four columns."""
    found = df.withColumn("_b", st_bounds(geometry)).withColumn("_e", extent_of(F.col("_b"), over=window))
    return found.drop("_b").select("*", "_e.*").drop("_e")


def extent_rollup(df: DataFrame, geometry: Column, by: list[str]) -> DataFrame:
    """The extent of each group and of all its prefixes."""
    return _bounded(df, geometry, by).rollup(*by).agg(_extent()).select(*by, "_e.*")
