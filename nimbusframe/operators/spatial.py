"""Neighbour joins, interpolation, gauge adjustment, compositing, zonal statistics and verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbusframe.functions.georef import overlap_area, point_in_ring
from nimbusframe.functions.moments import valid
from nimbusframe.operators.neighbours import met, nearest_in_blocks

#: Weight of a source that coincides with its target.
COINCIDENT = 1e12


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="nimbus-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def knn(targets: DataFrame, sources: DataFrame, k: int, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The k nearest sources of every target: trg_id, rank (1 is nearest), src_id, d2.

    ``targets`` has trg_id and the coordinates ``dims``; ``sources`` has src_id and them. Ties go to the smaller src_id. Sources are
    dealt into blocks of bounded size; a target is searched in its own block, then in those that may hold nearer ones.
    Nothing that grows with the data is broadcast. Points with a missing coordinate are left out on both sides.
    """
    there = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in dims))
    trg = there(targets.select("trg_id", *[F.col(c).cast("double").alias(c) for c in dims]))
    src = there(sources.select("src_id", *[F.col(c).cast("double").alias(c) for c in dims]))
    n = src.count()
    if not n or trg.isEmpty():
        return targets.sparkSession.createDataFrame([], "trg_id long, rank int, src_id long, d2 double")
    return nearest_in_blocks(trg, src, k, dims, n, settled)


def idw_weight(d2: Column, p: float = 2.0, maxdist: float | None = None) -> Column:
    w = F.when(d2 == 0, COINCIDENT).otherwise(F.pow(d2, F.lit(-p / 2.0)))
    return w if maxdist is None else F.when(d2 > maxdist * maxdist, 0.0).otherwise(w)


def idw(neighbours: DataFrame, values: DataFrame, fields: list[str], p: float = 2.0, maxdist: float | None = None, remove_missing: bool = False) -> DataFrame:
    """Inverse-distance means at the targets: trg_id and the fields. ``values`` has src_id and the fields.

    A missing value makes the result missing unless ``remove_missing``.
    """
    j = met(neighbours, values.select("src_id", *fields), "src_id").withColumn("__w", idw_weight(F.col("d2"), p, maxdist))

    def mean(f: str) -> Column:
        m = F.try_divide(F.sum(F.col("__w") * F.col(f)), F.sum(F.when(F.col(f).isNotNull(), F.col("__w"))))
        return (m if remove_missing else F.when(F.count_if(F.col(f).isNull()) == 0, m)).alias(f)

    return j.groupBy("trg_id").agg(*[mean(f) for f in fields])


def nearest(neighbours: DataFrame, values: DataFrame, fields: list[str], maxdist: float | None = None) -> DataFrame:
    """The value of the nearest source that has one, for each field."""
    j = met(neighbours, values.select("src_id", *fields), "src_id")
    take = lambda f: F.min_by(F.when(F.lit(True) if maxdist is None else F.col("d2") <= maxdist * maxdist, F.col(f)), F.when(F.col(f).isNotNull(), F.struct("d2", "src_id"))).alias(f)
    return j.groupBy("trg_id").agg(*[take(f) for f in fields])


# gauge adjustment: gauges (k, x, y, obs), raw (pt, x, y, raw)


def raw_at_gauges(gauges: DataFrame, raw: DataFrame, nnear: int = 9, stat: str = "median") -> DataFrame:
    """k and rawatobs: a statistic of the nnear raw values around each gauge; "best" takes the one closest to obs."""
    near = knn(gauges.select(F.col("k").alias("trg_id"), "x", "y"), raw.select(F.col("pt").alias("src_id"), "x", "y"), nnear)
    j = met(met(near, raw.select(F.col("pt").alias("src_id"), "raw"), "src_id"), gauges.select(F.col("k").alias("trg_id"), "obs"), "trg_id")
    value = {"median": F.median("raw"), "mean": F.avg("raw"), "min": F.min("raw"), "max": F.max("raw"), "best": F.min_by("raw", F.struct(F.abs(F.col("raw") - F.col("obs")), "rank"))}[stat]
    return j.groupBy(F.col("trg_id").alias("k")).agg(value.alias("rawatobs"))


def valid_pairs(gauges: DataFrame, raw: DataFrame, nnear: int = 9, stat: str = "median", minval: float = 0.0) -> DataFrame:
    """Gauges whose observation and raw value are both valid: k, x, y, obs, rawatobs."""
    j = met(gauges, raw_at_gauges(gauges, raw, nnear, stat), "k")
    return j.where(valid("obs", minval).isNotNull() & valid("rawatobs", minval).isNotNull()).select("k", "x", "y", "obs", "rawatobs")


def adjust(kind: str, gauges: DataFrame, raw: DataFrame, nnear_raws: int = 9, stat: str = "median", mingages: int = 5, minval: float = 0.0, nnearest: int = 4, p: float = 2.0) -> DataFrame:
    """``raw`` with adjusted: "add", "multiply", "mixed" errors interpolated to the grid, "gage_only" or "none".

    With fewer than ``mingages`` valid gauges the raw values come back.
    """
    if kind == "none":
        return raw.withColumn("adjusted", F.col("raw").cast("double"))
    pairs = settled(valid_pairs(gauges, raw, nnear_raws, stat, minval))
    if pairs.count() < mingages:
        return raw.withColumn("adjusted", F.col("raw").cast("double"))
    e = F.try_divide(F.col("obs") - F.col("rawatobs"), F.pow("rawatobs", F.lit(2.0)) + 1.0)
    errors = {"add": {"e": F.col("obs") - F.col("rawatobs")}, "multiply": {"e": F.try_divide(F.col("obs"), F.col("rawatobs"))}, "mixed": {"e": e, "d": F.try_divide(F.col("obs") - e, F.col("rawatobs")) - 1.0}, "gage_only": {"e": F.col("obs")}}[kind]
    source = pairs.select(F.col("k").alias("src_id"), "x", "y", *[v.alias(n) for n, v in errors.items()])
    near = knn(raw.select(F.col("pt").alias("trg_id"), "x", "y"), source.select("src_id", "x", "y"), nnearest)
    field = idw(near, source, list(errors), p).withColumnRenamed("trg_id", "pt")
    out = {"add": F.greatest(F.col("raw") + F.col("e"), F.lit(0.0)), "multiply": F.col("raw") * F.col("e"), "gage_only": F.col("e")}
    value = (1.0 + F.col("d")) * F.col("raw") + F.col("e") if kind == "mixed" else out[kind]
    return met(raw, field, "pt", "left").withColumn("adjusted", value).drop(*errors)


def adjust_mfb(gauges: DataFrame, raw: DataFrame, method: str = "mean", nnear_raws: int = 9, stat: str = "median", mingages: int = 5, minval: float = 0.0, minslope: float = 0.1, minr: float = 0.5, maxp: float = 0.01) -> DataFrame:
    """``raw`` times one factor: the mean or median of obs / raw, or the inverse slope of raw on obs without intercept if the regression is good enough."""
    pairs = valid_pairs(gauges, raw, nnear_raws, stat, minval)
    ratio = F.try_divide(F.col("obs"), F.col("rawatobs"))
    ok = pairs.where(ratio.isNotNull())
    s = ok.agg(F.count("*").alias("n"), F.avg(ratio).alias("mean"), F.median(ratio).alias("median"), F.try_divide(F.sum(F.col("obs") * F.col("rawatobs")), F.sum(F.col("obs") * F.col("obs"))).alias("through0"), F.regr_slope("rawatobs", "obs").alias("slope"), F.corr("obs", "rawatobs").alias("r"))
    row = s.first()
    factor = 1.0
    if row["n"] >= mingages:
        if method in ("mean", "median"):
            factor = row[method]
        elif row["slope"] is not None and row["r"] is not None and row["n"] > 2:
            if row["slope"] > minslope and row["r"] > minr and t_tail(row["r"], row["n"]) < maxp and row["through0"]:
                factor = 1.0 / row["through0"]
    return raw.withColumn("adjusted", F.col("raw") * F.lit(float(factor)))


def t_tail(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by the incomplete beta function's continued fraction."""
    if abs(r) >= 1:
        return 0.0
    x, a, b = 1 - r * r, (n - 2) / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                h *= d * c
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def cross_validate(gauges: DataFrame, raw: DataFrame, nnear_raws: int = 9, stat: str = "median", mingages: int = 5, minval: float = 0.0, nnearest: int = 4, p: float = 2.0) -> DataFrame:
    """Leave-one-out for the additive adjustment: k, obs, est; est is null for gauges that take no part.

    One job: each gauge looks for nnearest + 1 gauges and leaves itself out.
    """
    direct = raw_at_gauges(gauges, raw, 1, "mean").withColumnRenamed("rawatobs", "direct")
    pairs = settled(met(valid_pairs(gauges, raw, nnear_raws, stat, minval), direct, "k").where(valid("direct", minval).isNotNull()))
    if pairs.count() < mingages:
        return gauges.select("k", "obs", F.lit(None).cast("double").alias("est"))
    at = pairs.select(F.col("k").alias("src_id"), "x", "y", (F.col("obs") - F.col("rawatobs")).alias("e"))
    near = knn(at.select(F.col("src_id").alias("trg_id"), "x", "y"), at.select("src_id", "x", "y"), nnearest + 1).where("src_id <> trg_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("trg_id").orderBy("d2", "src_id"))).where(F.col("rank") <= nnearest)
    if pairs.count() - 1 < mingages:  # each gauge is estimated from the others, which are too few: its raw value stands
        return met(gauges.select("k", "obs"), pairs.select("k", F.col("direct").cast("double").alias("est")), "k", "left")
    est = met(idw(near, at, ["e"], p), pairs.select(F.col("k").alias("trg_id"), "direct"), "trg_id")
    return met(gauges.select("k", "obs"), est.select(F.col("trg_id").alias("k"), F.greatest(F.col("direct") + F.col("e"), F.lit(0.0)).alias("est")), "k", "left")


# compositing and gridding


def compose_ko(df: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the radar with the greatest quality in each cell; ties go to the smaller radar, null quality never wins."""
    return df.groupBy(*keys).agg(F.min_by("value", F.when(F.col("quality").isNotNull(), F.struct(-F.col("quality"), F.col("radar")))).alias("value"))


def compose_weighted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the radars' values by quality; null where no radar has a value."""
    q = F.when(F.col("value").isNotNull(), F.col("quality"))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col("value") * q), F.sum(q)).alias("value"))


def rect_bin(points: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, value: str = "value") -> DataFrame:
    """Mean of the points in each cell of a regular grid: col, row, value and n. The outer edges belong to the last cells."""
    at = lambda v, o, d, n: F.when(F.col(v) == o + n * d, n - 1).otherwise(F.floor((F.col(v) - o) / d))
    p = points.select(at("x", x0, dx, nx).alias("col"), at("y", y0, dy, ny).alias("row"), value)
    return p.where(F.col("col").between(0, nx - 1) & F.col("row").between(0, ny - 1)).groupBy("col", "row").agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def bilinear(grid: DataFrame, points: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Bilinear values at points of a regular grid (col, row, value): id and value; null outside or next to a missing node."""
    fx, fy = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    p = points.select("id", F.floor(fx).alias("c"), F.floor(fy).alias("r"), (fx - F.floor(fx)).alias("u"), (fy - F.floor(fy)).alias("v"))
    corner = [F.struct((F.col("c") + i).alias("col"), (F.col("r") + j).alias("row"), ((F.col("u") if i else 1 - F.col("u")) * (F.col("v") if j else 1 - F.col("v"))).alias("w")) for i in (0, 1) for j in (0, 1)]
    e = p.select("id", F.explode(F.array(*corner)).alias("n")).select("id", "n.*").where(F.col("w") > 0)
    j = met(e, grid.select("col", "row", "value"), ["col", "row"], "left")
    return j.groupBy("id").agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("w") * F.col("value"))).alias("value"))


def max_projections(volume: DataFrame) -> DataFrame:
    """Greatest value over each axis of a volume (x, y, z, value), in one pass of grouping sets; the missing axis is null."""
    return volume.groupingSets([["x", "y"], ["x", "z"], ["y", "z"]], "x", "y", "z").agg(F.max("value").alias("value"))


def fill_polar(df: DataFrame, value: str, n_rays: int, k: int = 1, p: float = 2.0) -> DataFrame:
    """One sweep (ray, bin, value) with its missing gates filled from the k gates nearest in the plane: inverse-distance means, the nearest with k of 1."""
    angle = F.radians(F.col("ray") * (360.0 / n_rays))
    at = df.select("ray", "bin", F.col(value).cast("double").alias("v"), (F.col("ray") * F.lit(1 << 32) + F.col("bin")).alias("id"), (F.cos(angle) * (F.col("bin") + 0.5)).alias("x"), (F.sin(angle) * (F.col("bin") + 0.5)).alias("y"))
    known = at.where("v is not null").select(F.col("id").alias("src_id"), "x", "y", "v")
    gaps = at.where("v is null").select(F.col("id").alias("trg_id"), "x", "y")
    near = knn(gaps, known, k)
    got = (nearest(near, known, ["v"]) if k == 1 else idw(near, known, ["v"], p)).select(F.col("trg_id").alias("id"), F.col("v").alias("f"))
    return met(at, got, "id", "left").select("ray", "bin", F.coalesce("v", "f").alias(value))


def within_radius(x0: float, y0: float, radius: float) -> Column:
    """Whether a point (x, y) is within reach of a radar."""
    return (F.col("x") - x0) * (F.col("x") - x0) + (F.col("y") - y0) * (F.col("y") - y0) < radius * radius


def sweep_to_raster(gates: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, radius: float, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """col, row, value of a raster: the mean of a cell's gates; an empty cell within the radius takes the gate nearest to its centre.

    ``gates`` has src_id, x, y, value, of which values may be missing. Cells beyond the radius without gates are null.
    """
    binned = rect_bin(gates, x0, y0, dx, dy, nx, ny).select("col", "row", "value")
    cells = gates.sparkSession.range(nx * ny).select((F.col("id") % nx).alias("col"), F.expr(f"id div {nx}").alias("row"), F.col("id").alias("trg_id"))
    cells = cells.withColumn("x", x0 + (F.col("col") + 0.5) * dx).withColumn("y", y0 + (F.col("row") + 0.5) * dy).join(binned, ["col", "row"], "left")
    empty = cells.where(F.col("value").isNull() & within_radius(*centre, radius)).select("trg_id", "x", "y")
    known = gates.where("value is not null").select("src_id", "x", "y", "value")
    filled = nearest(knn(empty, known, 1), known, ["value"]).select("trg_id", F.col("value").alias("f"))
    return cells.join(filled, "trg_id", "left").select("col", "row", F.coalesce("value", "f").alias("value"))


# zones


def zone_points(zones: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """Edges trg, src, w: the points in each zone's ring, each of equal weight. ``zones`` has trg, ring; ``points`` src, x, y.

    Zones are sent to the cells that their boxes touch, so only points of those cells are tested.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda a: F.sequence(F.floor(F.array_min(a) / cell), F.floor(F.array_max(a) / cell))
    z = zones.select("trg", "ring", F.explode(span(xs)).alias("cx"), ys.alias("ys")).select("trg", "ring", "cx", F.explode(span(F.col("ys"))).alias("cy"))
    p = points.select("src", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    inside = z.join(p, ["cx", "cy"]).where(point_in_ring("x", "y", F.col("ring"))).select("trg", "src")
    n = inside.groupBy("trg").agg(F.count("*").alias("n"))
    return inside.join(n, "trg").select("trg", "src", (1.0 / F.col("n")).alias("w"))


def zone_polygons(zones: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Edges trg, src, w: the share of each zone's covered area that a source polygon has. ``polygons`` has src and a convex anticlockwise ring.

    Both sides are sent to the cells their boxes touch; a pair is kept where the greater of its two lower corners lies, so it is clipped once.
    """
    def placed(df: DataFrame, key: str, ring: str) -> DataFrame:
        xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
        box = df.select(key, F.col("ring").alias(ring), *[f(v).alias(f"{key}_{n}") for f, v, n in ((F.array_min, xs, "l"), (F.array_max, xs, "r"), (F.array_min, ys, "b"), (F.array_max, ys, "t"))])
        span = lambda a, b: F.sequence(F.floor(F.col(f"{key}_{a}") / cell), F.floor(F.col(f"{key}_{b}") / cell))
        return box.select("*", F.explode(span("l", "r")).alias("cx")).select("*", F.explode(span("b", "t")).alias("cy"))

    j = placed(zones, "trg", "zone").join(placed(polygons, "src", "poly"), ["cx", "cy"])
    once = (F.floor(F.greatest("trg_l", "src_l") / cell) == F.col("cx")) & (F.floor(F.greatest("trg_b", "src_b") / cell) == F.col("cy"))
    apart = (F.col("trg_l") >= F.col("src_r")) | (F.col("src_l") >= F.col("trg_r")) | (F.col("trg_b") >= F.col("src_t")) | (F.col("src_b") >= F.col("trg_t"))
    area = j.where(once & ~apart).select("trg", "src", overlap_area(F.col("zone"), F.col("poly")).alias("a")).where("a > 0")
    total = area.groupBy("trg").agg(F.sum("a").alias("total"))
    return area.join(total, "trg").select("trg", "src", (F.col("a") / F.col("total")).alias("w"))


def zonal_stats(edges: DataFrame, values: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Weighted mean and population variance of each zone: trg, mean, var. ``values`` has src, value; with ``zones`` (trg) those without sources are there too, with nulls."""
    j = edges.join(values, "src")
    w, v = F.col("w"), F.col("value")
    m = j.groupBy("trg").agg(F.try_divide(F.sum(w * v), F.sum(w)).alias("mean"))
    out = j.join(m, "trg").groupBy("trg").agg(F.first("mean").alias("mean"), F.try_divide(F.sum(w * F.pow(v - F.col("mean"), F.lit(2.0))), F.sum(w)).alias("var"))
    return out if zones is None else zones.select("trg").distinct().join(out, "trg", "left")


# verification


def error_metrics(pairs: DataFrame, minval: float | None = None) -> DataFrame:
    """One row of metrics of obs and est, rounded half to even as published: corr, r2, spearman, nash, sse, mse, rmse, mas, meanerr, ratio, pbias.

    The rank correlation needs one global order of each side; it is got from counts by value, so no
    task holds all rows.
    """
    v = pairs.select(valid("obs", minval).alias("obs"), valid("est", minval).alias("est")).where("obs is not null and est is not null")

    def ranks(side: str) -> DataFrame:
        n = v.groupBy(side).agg(F.count("*").alias("n"))
        b = n.withColumn("__b", F.floor(F.col(side)))
        blocks = b.groupBy("__b").agg(F.sum("n").alias("m"))
        before = blocks.withColumn("before", F.sum("m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", F.coalesce("before", F.lit(0)).alias("before"))
        within = F.coalesce(F.sum("n").over(Window.partitionBy("__b").orderBy(side).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return b.join(before, "__b").select(side, (F.col("before") + within + (F.col("n") + 1) / 2).alias(f"rank_{side}"))

    r = v.join(ranks("obs"), "obs").join(ranks("est"), "est")
    d = F.col("est") - F.col("obs")
    a = r.agg(
        F.corr("obs", "est").alias("c"), F.corr("rank_obs", "rank_est").alias("s"), F.sum(d * d).alias("sse"), F.count("*").alias("n"), F.var_pop("obs").alias("var"),
        F.avg(F.abs(d)).alias("mas"), F.avg(d).alias("me"), F.avg(F.try_divide(F.col("est"), F.col("obs"))).alias("ratio"), F.avg("obs").alias("mo"),
    )
    sse = F.bround("sse", 2)
    mse = F.bround(sse / F.col("n"), 2)
    return a.select(
        F.bround("c", 2).alias("corr"), F.bround(F.col("c") * F.col("c"), 2).alias("r2"), F.bround("s", 2).alias("spearman"), F.bround(1.0 - F.try_divide(mse, F.col("var")), 2).alias("nash"),
        sse.alias("sse"), mse.alias("mse"), F.bround(F.sqrt(mse), 2).alias("rmse"), F.bround("mas", 2).alias("mas"), F.bround("me", 2).alias("meanerr"),
        F.bround("ratio", 2).alias("ratio"), F.bround(F.try_divide(F.bround("me", 2) * 100.0, F.col("mo")), 1).alias("pbias"),
    )


# kriging


def ordinary_kriging(neighbours: DataFrame, sources: DataFrame, field: str, sill: float = 1.0, rng: float = 10000.0, drift: DataFrame | None = None) -> DataFrame:
    """trg_id, value and variance by ordinary kriging with an exponential covariance on each target's neighbours.

    With ``drift`` (trg_id, drift) the field follows an external variable, which ``sources`` have too (column drift). Only the small system of a target (its k neighbours) is solved in numpy; targets come in Arrow batches.
    """
    import numpy as np

    own = F.col("drift").cast("double") if drift is not None else F.lit(None).cast("double")
    packed = met(neighbours, sources.select("src_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(field).alias("v"), own.alias("sd")), "src_id").groupBy("trg_id").agg(F.array_sort(F.collect_list(F.struct("rank", "d2", "sx", "sy", "v", "sd"))).alias("near"))
    flat = packed.select("trg_id", *[F.col("near")[n].cast("array<double>").alias(n) for n in ("d2", "sx", "sy", "v", "sd")])
    flat = met(flat, drift.select("trg_id", F.col("drift").cast("double").alias("td")), "trg_id") if drift is not None else flat.withColumn("td", F.lit(None).cast("double"))
    drifting = drift is not None

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, d2, sx, sy, v, sd, td in b.itertuples(index=False):
                n = len(v)
                a = np.ones((n + 1 + drifting, n + 1 + drifting))
                a[n:, n:] = 0
                a[:n, :n] = sill * np.exp(-np.hypot(sx[:, None] - sx, sy[:, None] - sy) / rng)
                rhs = np.append(sill * np.exp(-np.sqrt(d2) / rng), 1.0)
                if drifting:
                    a[:n, -1] = a[-1, :n] = sd
                    rhs = np.append(rhs, td)
                w = np.linalg.lstsq(a, rhs, rcond=None)[0]
                out.append((t, float(w[:n] @ v), float(sill - w @ rhs)))
            yield pd.DataFrame(out, columns=["trg_id", "value", "variance"])

    return flat.mapInPandas(solve, "trg_id long, value double, variance double")
