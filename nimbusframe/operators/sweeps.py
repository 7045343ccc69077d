"""Operators that need a whole sweep, or a search along each ray: attenuation under constraints, rain cells, clutter.

Rays come packed (an array of values by bin). A search along a ray works on Arrow batches of rays; an
operator across rays gets one sweep at a time, whose size is that of an antenna's revolution and
doesn't follow the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbusframe.operators.neighbours import met
from nimbusframe.operators.rays import packed, similar_neighbours
from nimbusframe.operators.spatial import settled

#: Most rounds of a bisection; a ray that has not met its reference by then has null coefficients.
MOST_ROUNDS = 500
#: Bins of a strip in which one task looks for rain cells.
STRIP = 2048


def forward(z: np.ndarray, a: np.ndarray | float, b: np.ndarray | float, dr: float) -> np.ndarray:
    """Two-way attenuation up to each gate, for rays (rows) of dBZ."""
    pia = np.zeros(z.shape)
    with np.errstate(over="ignore", invalid="ignore"):
        for g in range(1, z.shape[1]):
            before = pia[:, g - 1]
            pia[:, g] = before + a * (10.0 ** ((z[:, g - 1] + before) / 10.0)) ** b * 2.0 * dr
    return pia


def bisected(z: np.ndarray, ref: np.ndarray, a_max: float, a_min: float, b_start: float, dr: float, mode: str, tolerance: float, patience: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attenuation, a and b of each ray such that the last gate has the attenuation ``ref``.

    a is halved in; after ``patience`` rounds b gives way too, by 0.01 a round.
    """
    if mode not in ("difference", "ratio"):
        raise ValueError("mode must be 'difference' or 'ratio'")
    n = len(z)
    high, low, b, a = np.full(n, a_max), np.full(n, a_min), np.full(n, b_start), np.full(n, np.nan)
    pia, left = np.zeros(z.shape), np.arange(n)
    for k in range(MOST_ROUNDS):
        if not len(left):
            break
        a[left] = (high[left] + low[left]) / 2
        pia[left] = forward(z[left], a[left], b[left], dr)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (pia[left, -1] - ref[left]) / (ref[left] if mode == "ratio" else 1.0)
        over, under = left[off > tolerance], left[off < -tolerance]
        high[over], low[under] = a[over], a[under]
        left = np.concatenate([over, under])
        if k >= patience:
            b[over] -= 0.01
            b[under] += 0.01
    a[left] = b[left] = np.nan
    return pia, a, b


def long_runs(flags: np.ndarray, least: int) -> np.ndarray:
    """Which flags stand in a run of at least ``least``; the last is next to the first."""
    n = len(flags)
    if flags.all():
        return np.full(n, n >= least)
    start = int(np.flatnonzero(~flags)[0])
    turned = np.roll(flags, -start)
    edge = np.diff(np.concatenate([[0], turned.astype(np.int8), [0]]))
    out = np.zeros(n, dtype=bool)
    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out[s:e] = e - s >= least
    return np.roll(out, start)


def bisect_reference_attenuation(rays: DataFrame, keys: list[str], a_max: float = 1.67e-4, a_min: float = 2.33e-5, b_start: float = 0.7, gate_length: float = 1.0, mode: str = "difference", tolerance: float = 0.25, patience: int = 10) -> DataFrame:
    """keys, ray, pia (array), a and b. ``rays`` has values (dBZ by bin) and pia_ref, the attenuation of the last gate."""
    names = [*keys, "ray"]
    schema = ", ".join(f"{n} {rays.schema[n].dataType.simpleString()}" for n in names) + ", pia array<double>, a double, b double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, g in batch.groupby(batch["values"].map(len)):
                pia, a, b = bisected(np.stack(g["values"].to_numpy()).astype(float), g["pia_ref"].to_numpy(float), a_max, a_min, b_start, gate_length, mode, tolerance, patience)
                yield g[names].assign(pia=list(pia), a=a, b=b)

    return rays.select(*names, "values", "pia_ref").mapInPandas(run, schema)


def constrained(z: np.ndarray, a_max: float, a_min: float, n_a: int, b_max: float, b_min: float, n_b: int, dr: float, most_dbz: float | None, most_pia: float | None, sector: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sweep: the largest coefficients that keep each wide sector within the limits; narrow ones follow their neighbours."""
    n = len(z)
    pia, a_used, b_used = np.zeros(z.shape), np.zeros(n), np.zeros(n)
    todo, narrow = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    for a, b in ((a, b) for b in np.linspace(b_max, b_min, n_b) for a in np.linspace(a_max, a_min, n_a)):
        pia[todo], a_used[todo], b_used[todo] = forward(z[todo], a, b, dr), a, b
        bad = np.zeros(n, dtype=bool)
        if most_dbz is not None:
            bad |= (z + pia > most_dbz).any(axis=1)
        if most_pia is not None:
            bad |= pia.max(axis=1) > most_pia
        todo = long_runs(bad, sector)
        narrow |= bad & ~todo
        if not todo.any():
            break
    if narrow.any() and not narrow.all():
        at = np.arange(n)
        ref = np.interp(at[narrow], at[~narrow], pia[~narrow, -1], period=n)
        pia[narrow], a_used[narrow], b_used[narrow] = bisected(z[narrow], ref, a_max, a_min, b_max, dr, "difference", 0.25, 10)
    return pia, a_used, b_used


def constrained_attenuation(df: DataFrame, value: str, keys: list[str], a_max: float = 1.67e-4, a_min: float = 2.33e-5, n_a: int = 4, b_max: float = 0.7, b_min: float = 0.65, n_b: int = 6, gate_length: float = 1.0, most_dbz: float | None = None, most_pia: float | None = None, sector: int = 10) -> DataFrame:
    """keys, ray, pia (array), a and b: attenuation with coefficients lowered until no wide sector breaks a limit.

    ``most_dbz`` limits the corrected value of every gate, ``most_pia`` the attenuation. Rays of runs
    shorter than ``sector`` get the attenuation of their last gate by interpolation between the rays around
    and are fitted to it. The rays of a sweep must have equally many gates, without missing values.
    """
    rays = packed(df, value, keys)
    schema = ", ".join(f"{n} {rays.schema[n].dataType.simpleString()}" for n in [*keys, "ray"]) + ", pia array<double>, a double, b double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ray")
        pia, a, b = constrained(np.stack(g["values"].to_numpy()).astype(float), a_max, a_min, n_a, b_max, b_min, n_b, gate_length, most_dbz, most_pia, sector)
        return g[[*keys, "ray"]].assign(pia=list(pia), a=a, b=b)

    return rays.groupBy(*keys).applyInPandas(run, schema)


def cell_numbers(on: np.ndarray) -> np.ndarray:
    """Numbers (1 and up) of the 8-connected cells of a mask, 0 elsewhere; the edges don't wrap."""
    number = np.full(on.shape, -1)
    number[on] = np.arange(on.sum())
    pairs = [(number[:, :-1], number[:, 1:]), (number[:-1], number[1:]), (number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])]
    a, b = (np.concatenate([p[k].ravel() for p in pairs]) for k in (0, 1))
    both = (a >= 0) & (b >= 0)
    a, b = a[both], b[both]
    root = np.arange(on.sum())
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(on.shape, dtype=np.int64)
    out[on] = np.unique(root, return_inverse=True)[1] + 1
    return out


def cell_ratio(v: np.ndarray, threshold: float) -> np.ndarray:
    """Area over border of the rain cell of each gate. Dry gates share one ratio: their number over minus all border gates."""
    on = v > threshold
    edge = np.pad(on, 1)
    inner = np.logical_and.reduce([edge[i : i + on.shape[0], j : j + on.shape[1]] for i in range(3) for j in range(3)])
    number = cell_numbers(on)
    area = np.bincount(number.ravel()).astype(float)
    border = np.bincount(number.ravel(), weights=(on & ~inner).ravel()).astype(float)
    border[0] = -border.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return (area / border)[number]


def joined(pairs: pd.DataFrame) -> np.ndarray:
    """A number for each end of the pairs (one, other), the same for all that hang together: those of ``one``, then those of ``other``."""
    name, at = np.unique(np.concatenate([pairs["one"], pairs["other"]]), return_inverse=True)
    x, y = at[: len(pairs)], at[len(pairs) :]
    root = np.arange(len(name))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return root[at]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def rain_cells(df: DataFrame, value: str, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """keys, ray, bin and ``ratio``: area over border gates of the cell above the threshold that a gate is in.

    Cells are 8-connected and don't wrap; gates past the edges count as dry. Null gates count as rain. The
    ratio is null where there is no border at all. Dry gates share one ratio: their number, with gates that are missing, over minus all border gates.

    Cells are found in strips of bins, each with the nearest bin of the strips beside it; what is one cell across strips is told by
    the gates that two strips have. These few links of a sweep are one task's table.
    """
    names, by = [*keys, "ray", "bin"], [*keys, "__s"]
    full = df.select(*names, F.coalesce(F.col(value).cast("double"), F.lit(float("inf"))).alias("__v")).withColumns({"__s": F.lit(0), "__t": F.floor(F.col("bin") / STRIP).cast("long")})
    ranks = full.select(*by, "ray").distinct().withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("ray")))
    beside = Window.partitionBy(*by).orderBy("__t")
    strips = full.groupBy(*by, "__t").agg(F.min("bin").alias("__low"), F.max("bin").alias("__high")).withColumns({"__before": F.lag("__t").over(beside), "__after": F.lead("__t").over(beside)})
    edge = ((F.col("bin") == F.col("__low")) & F.col("__before").isNotNull()) | ((F.col("bin") == F.col("__high")) & F.col("__after").isNotNull())
    goes = F.array(F.col("__t"), F.when(F.col("bin") == F.col("__low"), F.col("__before")), F.when(F.col("bin") == F.col("__high"), F.col("__after")))
    sent = full.join(ranks, [*by, "ray"]).join(strips, [*by, "__t"]).select(*by, "ray", "bin", "__v", "__r", edge.alias("__edge"), F.col("__t").alias("__own"), F.explode(F.filter(goes, lambda t: t.isNotNull())).alias("__t"))
    sent = sent.withColumn("__own", F.col("__own") == F.col("__t"))
    schema = ", ".join(f"{n} {sent.schema[n].dataType.simpleString()}" for n in [*by, "ray", "bin", "__t", "__own", "__edge"]) + ", __c long, __b boolean, __area double, __border double"

    def label(g: pd.DataFrame) -> pd.DataFrame:
        i = (g["__r"] - g["__r"].min()).to_numpy()
        j = np.unique(g["bin"], return_inverse=True)[1]
        v = np.full((i.max() + 1, j.max() + 1), -np.inf)
        v[i, j] = g["__v"]
        on = v > threshold
        wide = np.pad(on, 1)
        inner = np.logical_and.reduce([wide[x : x + on.shape[0], y : y + on.shape[1]] for x in range(3) for y in range(3)])
        c, b, own = cell_numbers(on)[i, j], (on & ~inner)[i, j], g["__own"].to_numpy()
        area, border = (np.bincount(c, weights=own & w)[c] for w in (True, b))
        return g[[*by, "ray", "bin", "__t", "__own", "__edge"]].assign(__c=c, __b=b, __area=area, __border=border)

    found = settled(sent.groupBy(*by, "__t").applyInPandas(label, schema))

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        root = joined(g)
        ends = pd.DataFrame({"__id": np.concatenate([g["one"], g["other"]]), "__root": root}).drop_duplicates()
        return ends.assign(**{n: g[n].iloc[0] for n in by})[[*by, "__id", "__root"]]

    number = (F.col("__t") * F.lit(1 << 32) + F.col("__c")).alias("__id")
    shared = found.where("__edge and __c > 0").select(*by, "ray", "bin", "__own", number)
    pairs = shared.where("__own").withColumnRenamed("__id", "one").drop("__own").join(shared.where("not __own").withColumnRenamed("__id", "other").drop("__own").hint("merge"), [*by, "ray", "bin"]).select(*by, "one", "other").distinct()
    roots = pairs.groupBy(*by).applyInPandas(unite, ", ".join(f"{n} {sent.schema[n].dataType.simpleString()}" for n in by) + ", __id long, __root long")
    parts = found.where("__c > 0").select(*by, number, "__area", "__border").join(roots, [*by, "__id"]).distinct()
    whole = parts.groupBy(*by, "__root").agg(F.sum("__area").alias("__whole"), F.sum("__border").alias("__rim"))
    across = parts.select(*by, "__id", "__root").join(whole, [*by, "__root"]).drop("__root")
    size = full.groupBy(*by).agg((F.count_distinct("ray") * F.count_distinct("bin")).alias("__n"))
    rim = found.where("__own").groupBy(*by).agg(F.count_if(F.col("__c") > 0).alias("__on"), F.count_if("__b").alias("__b"))
    dry = size.join(rim, by).select(*by, F.try_divide((F.col("__n") - F.col("__on")).cast("double"), -F.col("__b").cast("double")).alias("__dry"))
    own = found.where("__own").select(*by, "ray", "bin", "__c", number, "__area", "__border").join(across, [*by, "__id"], "left").join(dry, by)
    ratio = F.when(F.col("__c") == 0, F.col("__dry")).otherwise(F.try_divide(F.coalesce("__whole", "__area"), F.coalesce("__rim", "__border")))
    return own.select(*names, ratio.alias("ratio"))


def clutter(df: DataFrame, value: str, keys: list[str], n_rays: int, n_bins: int, wsize: int = 5, threshold: float = 0.0, tr1: float = 6.0, n_p: int = 6, tr2: float = 1.3) -> DataFrame:
    """Adds ``clutter``: too few similar gates around, or in a cell that is nearly all border. Null gates count as endlessly strong."""
    full = df.withColumn("__full", F.coalesce(F.col(value).cast("double"), F.lit(float("inf"))))
    near = similar_neighbours(full, "__full", keys, n_rays, n_bins, wsize, tr1)
    cells = rain_cells(df, value, keys, threshold)
    speckle: Column = F.coalesce(F.abs("ratio") < tr2, F.lit(False))
    return met(near, cells, [*keys, "ray", "bin"]).withColumn("clutter", (F.col("similar") < n_p) | speckle).drop("__full", "similar", "ratio")
