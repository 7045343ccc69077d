"""Radar volumes on regular grids at constant altitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusframe.functions.georef import bin_altitude
from nimbusframe.operators.spatial import idw, knn


def blind(site: tuple[float, float, float], minelev: float, maxelev: float, maxrange: float) -> tuple[Column, Column, Column]:
    """Whether a point (x, y, z) is below the lowest beam, above the highest, or out of range."""
    d = F.sqrt(sum((F.pow(F.col(v) - float(s), F.lit(2.0)) for v, s in zip("xyz", site, strict=True)), F.lit(0.0)))
    return F.col("z") < bin_altitude(d, F.lit(float(minelev)), site[2]), F.col("z") > bin_altitude(d, F.lit(float(maxelev)), site[2]), d > float(maxrange)


def cappi(gates: DataFrame, grid: DataFrame, site: tuple[float, float, float], maxrange: float, minelev: float | None = None, maxelev: float | None = None, nnearest: int = 4, p: float = 2.0) -> DataFrame:
    """id and value of every grid point: inverse-distance means of the nearest gates, null where the radar doesn't see.

    ``gates`` has src_id, x, y, z and value, ``grid`` id, x, y, z. Without elevations only the range limits the view.
    """
    below, above, far = blind(site, minelev or 0.0, maxelev or 0.0, maxrange)
    hidden = far if minelev is None or maxelev is None else below | above | far
    seen = grid.where(~hidden).select(F.col("id").alias("trg_id"), "x", "y", "z")
    near = knn(seen, gates.select("src_id", "x", "y", "z"), nnearest, dims=("x", "y", "z"))
    value = idw(near, gates.select("src_id", "value"), ["value"], p)
    return grid.select("id").join(value.withColumnRenamed("trg_id", "id"), "id", "left")
