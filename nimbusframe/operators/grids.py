"""Sweep and grid coordinates as tables, rasters turned, merged and measured, results chained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbusframe.functions import georef as G
from nimbusframe.operators.neighbours import met
from nimbusframe.operators.rays import along, gradient

#: Fixed values of the composite grids by (rows, columns): first column's and row's offset from the reference point, and resolution, in km.
COMPOSITES = {
    (200, 200): (200, 200, 2), (450, 450): (450, 450, 2), (460, 460): (460, 460, 2), (900, 900): (450, 450, 1), (1100, 900): (370, 550, 1),
    (1200, 1100): (470, 600, 1), (2400, 2400): (1550, 1250, 1), (1500, 1400): (600, 800, 1), (4800, 4400): (470, 600, 0.25), (5300, 6500): (0, 0, 1),
}
#: Longitude and latitude of the composite grids' reference point.
REFERENCE = (9.0, 51.0)


def axes(spark: SparkSession, **lengths: int) -> DataFrame:
    """Every combination of indices from 0 on, one column an axis: a mesh whose size is the axes' product."""
    names = list(lengths)
    total = 1
    for n in lengths.values():
        total *= n
    out, rest = spark.range(total), F.col("id")
    columns = []
    for name in reversed(names):
        columns.append((rest % lengths[name]).alias(name))
        rest = F.floor(rest / lengths[name])
    return out.select(*reversed(columns))


def sweep_centroids(spark: SparkSession, rays: int, bins: int, scale: float, elevation: float) -> DataFrame:
    """ray, bin, range, azimuth and elevation of the gate centres of an ideal sweep."""
    step = 360.0 / rays
    return axes(spark, ray=rays, bin=bins).select("ray", "bin", ((F.col("bin") + 0.5) * scale).alias("range"), ((F.col("ray") + 0.5) * step).alias("azimuth"), F.lit(float(elevation)).alias("elevation"))


def volume_coordinates(spark: SparkSession, elevations: list[float], rays: int, bins: int, scale: float, site_altitude: float) -> DataFrame:
    """elevation, ray, bin and x, y, z about the site of the gates of a volume of ideal sweeps."""
    el = F.element_at(F.array(*map(F.lit, map(float, elevations))), F.col("scan").cast("int") + 1)
    gates = axes(spark, scan=len(elevations), ray=rays, bin=bins).withColumn("elevation", el)
    x, y, z = G.spherical_to_xyz((F.col("bin") + 0.5) * scale, (F.col("ray") + 0.5) * (360.0 / rays), F.col("elevation"), site_altitude)
    return gates.select("elevation", "ray", "bin", x.alias("x"), y.alias("y"), z.alias("z"))


def grid_3d(spark: SparkSession, centre: tuple[float, float], maxrange: float, maxalt: float, horizontal: float, vertical: float, minalt: float = 0.0) -> DataFrame:
    """id, x, y, z of a regular grid around a centre."""
    n, m = (int(-(-(2 * maxrange + horizontal) // horizontal)), int(-(-(maxalt + vertical - minalt) // vertical)))
    cells = axes(spark, level=m, row=n, col=n)
    at = lambda i, first, step: (F.col(i) * float(step) + float(first))
    return cells.select((F.col("level") * (n * n) + F.col("row") * n + F.col("col")).alias("id"), at("col", centre[0] - maxrange, horizontal).alias("x"), at("row", centre[1] - maxrange, horizontal).alias("y"), at("level", minalt, vertical).alias("z"))


def composite_grid(spark: SparkSession, rows: int = 900, cols: int = 900, mode: str = "radolan") -> DataFrame:
    """row, col, x, y (km) and lon, lat of a composite grid: its cells' lower left corners, their "center", or every "edge"."""
    if (rows, cols) not in COMPOSITES:
        raise ValueError(f"no composite grid has {rows} rows and {cols} columns")
    if mode not in ("radolan", "center", "edge"):
        raise ValueError(f"unknown mode {mode!r}")
    left, low, step = COMPOSITES[rows, cols]
    more, half = int(mode == "edge"), step / 2 if mode == "center" else 0.0
    x0, y0 = G.lonlat_to_stereographic(F.lit(REFERENCE[0]), F.lit(REFERENCE[1]))
    cells = axes(spark, row=rows + more, col=cols + more)
    cells = cells.select("row", "col", (x0 - left + F.col("col") * float(step) + half).alias("x"), (y0 - low + F.col("row") * float(step) + half).alias("y"))
    lon, lat = G.stereographic_to_lonlat("x", "y")
    return cells.select("row", "col", "x", "y", lon.alias("lon"), lat.alias("lat"))


def georeference(gates: DataFrame, site_altitude: float, range_: str = "range", azimuth: str = "azimuth", elevation: str = "elevation") -> DataFrame:
    """Adds x, y, z about the site and the distance on the ground, gr."""
    x, y, z = G.spherical_to_xyz(F.col(range_), F.col(azimuth), F.col(elevation), site_altitude)
    return gates.withColumns({"x": x, "y": y, "z": z, "gr": F.hypot(x, y)})


def cell_rings(corners: DataFrame) -> DataFrame:
    """row, col and the ring of each cell of a grid of corners (row, col, x, y)."""
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = corners.select("row", "col", point.alias("p"))
    # Each corner is the first of its own cell and stands at other places in up to three cells before it.
    place = F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(n).alias("n")) for n, (i, j) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)])])
    dealt = p.select("p", F.explode(place).alias("at")).select("at.*", "p")
    rings = dealt.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("c")).where(F.size("c") == 4)
    points = F.transform("c", lambda s: s["p"])
    return rings.select("row", "col", F.concat(points, F.slice(points, 1, 1)).alias("ring"))


def extent(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """xmin, xmax, ymin, ymax and the aspect (width by height) of points, for each key if there are any."""
    ends = [f(v).alias(f"{v}{n}") for v in "xy" for n, f in (("min", F.min), ("max", F.max))]
    found = points.groupBy(*(keys or [])).agg(*ends)
    return found.withColumn("aspect", F.try_divide(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))


def flipped(raster: DataFrame, rows: int) -> DataFrame:
    """The raster with its other side first: row 0 becomes the last of ``rows``."""
    return raster.withColumn("row", F.lit(rows - 1) - F.col("row"))


def merged_rasters(cells: DataFrame, order: str = "source") -> DataFrame:
    """row, col, value: of cells that several sources have, the value of the last source that has one there."""
    return cells.groupBy("row", "col").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col(order))).alias("value"))


def chained(results: list[DataFrame], key: str, field: str) -> DataFrame:
    """The first result's field, and where it is null the next one's, for the first result's keys; a key may stand once in each."""
    named = [r.select(key, F.col(field).alias(f"__{n}")) for n, r in enumerate(results)]
    j = reduce(lambda a, b: met(a, b, key, "left"), named)
    return j.select(key, F.coalesce(*[f"__{n}" for n in range(len(results))]).alias(field))


def rolled(gates: DataFrame, rays: int = 360, by_rays: int = 0, by_bins: int = 0, value: str = "dbz") -> DataFrame:
    """ray, bin and the value of the gate that lies so many rays and bins before; rays run in a circle, beyond a ray's ends is nothing."""
    moved = gates.select(F.pmod(F.col("ray") + by_rays, F.lit(rays)).alias("ray"), (F.col("bin") + by_bins).alias("bin"), value)
    return gates.select("ray", "bin").join(moved, ["ray", "bin"], "left")


def median_smoothed(gates: DataFrame, value: str, keys: list[str], n: int = 5) -> DataFrame:
    """Adds ``smooth``: the median of n gates along the ray, with zeros beyond its ends."""
    w = along(keys)
    near = [F.coalesce(F.lag(F.col(value), -k, 0.0).over(w), F.lit(0.0)) if k else F.col(value) for k in range(-(n // 2), n // 2 + 1)]
    return gates.withColumn("smooth", F.sort_array(F.array(*near))[n // 2])


def smoothed_gradient(gates: DataFrame, value: str, keys: list[str], n: int = 5) -> DataFrame:
    """Adds ``slope``: the gradient of the median-smoothed value."""
    return median_smoothed(gates, value, keys, n).withColumn("slope", gradient(F.col("smooth"), keys))


def cumulative_blockage(gates: DataFrame, pbb: str, keys: list[str]) -> DataFrame:
    """Adds ``cbb``: the greatest partial blockage so far along the ray."""
    return gates.withColumn("cbb", F.max(pbb).over(along(keys).rowsBetween(Window.unboundedPreceding, 0)))
