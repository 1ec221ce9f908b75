"""Elevations from a raster held as a table (row, column, height), null where unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bilinear(points: DataFrame, raster: DataFrame, key: str) -> DataFrame:
    """(key, elevation) of points (key, at_row, at_column) in raster units; places outside are
    moved to the edge, and a point with an unknown corner has none. One equi join on corners,
    whose weighted heights are summed before the shuffle."""
    size = raster.agg(F.max("row").alias("rows"), F.max("column").alias("columns"))
    inside = points.crossJoin(F.broadcast(size)).select(key, F.greatest(F.lit(0.0), F.least("at_row", F.col("rows").cast("double"))).alias("r"), F.greatest(F.lit(0.0), F.least("at_column", F.col("columns").cast("double"))).alias("c"), "rows", "columns")
    r0, c0 = F.floor("r"), F.floor("c")
    fr, fc = F.col("r") - r0, F.col("c") - c0
    r1, c1 = F.least(r0 + 1, F.col("rows")), F.least(c0 + 1, F.col("columns"))
    corner = lambda r, c, w: F.struct(r.cast("long").alias("row"), c.cast("long").alias("column"), w.alias("weight"))
    corners = F.array(corner(r0, c0, (1 - fr) * (1 - fc)), corner(r0, c1, (1 - fr) * fc), corner(r1, c0, fr * (1 - fc)), corner(r1, c1, fr * fc))
    looked = inside.select(key, F.explode(corners).alias("corner")).select(key, "corner.*")
    met = looked.join(raster, ["row", "column"], "left").groupBy(key).agg(F.count("height").alias("known"), F.sum(F.col("weight") * F.col("height")).alias("elevation"))
    return met.select(key, F.when(F.col("known") == 4, F.col("elevation")).alias("elevation"))
