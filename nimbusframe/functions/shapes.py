"""Column functions of rings and regular grids: corners, centroids, places of points in grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbusframe.functions.moments import c


def ring(corners: list[tuple[Column, Column]]) -> Column:
    """A closed ring of (x, y) from its corners."""
    points = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]
    return F.array(*points, points[0])


def box_around(x, y, dx, dy) -> Column:
    """Ring of a cell from its centre and sizes: lower left, lower right, upper right, upper left."""
    x, y, dx, dy = c(x), c(y), c(dx) / 2, c(dy) / 2
    return ring([(x - dx, y - dy), (x + dx, y - dy), (x + dx, y + dy), (x - dx, y + dy)])


def ring_around(x, y, delta_x: float, delta_y: float) -> Column:
    """Ring at a distance from a centroid on either side: lower left, upper left, upper right, lower right."""
    x, y = c(x), c(y)
    return ring([(x - delta_x, y - delta_y), (x - delta_x, y + delta_y), (x + delta_x, y + delta_y), (x + delta_x, y - delta_y)])


def ring_centroid(r: Column) -> Column:
    """Centre of the area within a closed ring, as (x, y); null if it has none."""

    def add(s: Column, i: Column) -> Column:
        a, b = F.get(r, i), F.get(r, i + 1)
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((s["area"] + cross).alias("area"), (s["x"] + (a["x"] + b["x"]) * cross).alias("x"), (s["y"] + (a["y"] + b["y"]) * cross).alias("y"))

    none = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    centre = lambda s: F.when(s["area"] != 0, F.struct((s["x"] / (3 * s["area"])).alias("x"), (s["y"] / (3 * s["area"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), none, add, centre)


def edges_of(centres: Column) -> Column:
    """The edges between an array of cell centres and beyond the outermost, which may be unevenly spaced."""
    n = F.size(centres)
    mid = lambda i: (F.get(centres, i) + F.get(centres, i + 1)) / 2
    first = F.get(centres, F.lit(0)) - (F.get(centres, F.lit(1)) - F.get(centres, F.lit(0))) / 2
    last = F.get(centres, n - 1) + (F.get(centres, n - 1) - F.get(centres, n - 2)) / 2
    return F.concat(F.array(first), F.transform(F.sequence(F.lit(0), n - 2), mid), F.array(last))


def even_edges(centres: Column) -> Column:
    """The edges around evenly spaced centres, by the first spacing."""
    half = (F.get(centres, F.lit(1)) - F.get(centres, F.lit(0))) / 2
    return F.concat(F.array(F.get(centres, F.lit(0)) - half), F.transform(centres, lambda v: v + half))


def pixel_to_map(col, row, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel by an affine transform: x0, x by column, x by row, y0, y by column, y by row."""
    x0, xc, xr, y0, yc, yr = transform
    return x0 + xc * c(col) + xr * c(row), y0 + yc * c(col) + yr * c(row)


def grid_index(v, first: float, step: float) -> Column:
    """Fractional index of a coordinate on a regular axis."""
    return (c(v) - first) / step


def product_time(name) -> Column:
    """Time in a product's file name: the run of ten (two-digit year) or twelve digits after the site number."""
    digits = F.regexp_extract(name, r"[_-]\d{5}-(\d{12}|\d{10})-", 1)
    whole = F.when(F.length(digits) == 10, F.concat(F.lit("20"), digits)).otherwise(digits)
    return F.when(F.length(digits) > 0, F.to_timestamp(whole, "yyyyMMddHHmm"))


def rain_type(code) -> Column:
    """Satellite rain type from its eight-digit code: stratiform 1 and convective 2; other types count as 1."""
    kind = F.floor(c(code) / 10_000_000)
    return F.when(kind == 3, 1).otherwise(kind).cast("int")


def probabilistic_round(v, digits: int = 0, seed: int | None = None) -> Column:
    """Rounds away from zero with the probability of what is left over, so that means are kept."""
    scaled = F.abs(c(v)) * 10**digits
    whole = F.floor(scaled)
    return F.signum(c(v)) * (whole + (F.rand(seed) < scaled - whole).cast("int")) / 10**digits
