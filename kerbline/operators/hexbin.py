"""Two-dimensional density on hexagonal cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def hexbin(df: DataFrame, x: str, y: str, cells: int) -> DataFrame:
    """Count of points per hexagon, ``cells`` across: centre_x, centre_y, n.

    Hexagon centres form two rectangular lattices, the second shifted by half a cell; a point belongs
    to the nearest centre. The grid spans the data's extent, one row found by an aggregation.
    """
    points = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    extent = points.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if extent[0] is None:
        extent = (0.0, 0.0, 0.0, 0.0)
    x0, x1, y0, y1 = extent
    (x0, x1), (y0, y1) = _widened(x0, x1), _widened(y0, y1)
    margin = 1e-9 * (x1 - x0)
    x0, x1 = x0 - margin, x1 + margin
    width = (x1 - x0) / cells
    height = (y1 - y0) / int(cells / math.sqrt(3))

    across, up = (F.col("_x") - x0) / width, (F.col("_y") - y0) / height
    cell = points.withColumns({"_u": across, "_v": up}).withColumns({
        "_near_u": F.bround("_u"), "_near_v": F.bround("_v"), "_half_u": F.floor("_u") + 0.5, "_half_v": F.floor("_v") + 0.5,
    })
    on_first = _distance("_near") < _distance("_half")
    return (
        cell.select(F.when(on_first, F.col("_near_u")).otherwise(F.col("_half_u")).alias("_u"),
                    F.when(on_first, F.col("_near_v")).otherwise(F.col("_half_v")).alias("_v"))
        .groupBy("_u", "_v").agg(F.count("*").alias("n"))
        .select((F.col("_u") * width + x0).alias("centre_x"), (F.col("_v") * height + y0).alias("centre_y"), "n")
    )


def _distance(lattice: str) -> Column:
    du, dv = F.col("_u") - F.col(f"{lattice}_u"), F.col("_v") - F.col(f"{lattice}_v")
    return du * du + 3 * (dv * dv)


def _widened(low: float, high: float) -> tuple[float, float]:
    """An extent of no width is opened a little on both sides."""
    if high > low:
        return low, high
    return low - max(abs(low) * 0.1, 0.1), high + max(abs(high) * 0.1, 0.1)
