"""Operators along rays and over neighbouring gates.

Input is long: one row per gate with ``sweep`` keys, ``ray`` and ``bin``. Range-direction
operators are windows over (keys, ray) ordered by bin; cyclic neighbours are reached by copying
the edge rays, which keeps everything in one window shuffle. No operator gathers more than a ray.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbusframe.functions.moments import decibel, z_to_r


def along(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "ray").orderBy("bin")


def running_sum(v: Column, keys: list[str]) -> Column:
    return F.sum(v).over(along(keys).rowsBetween(Window.unboundedPreceding, 0))


def cumtrapz(v: Column, keys: list[str], dr: float = 1.0) -> Column:
    """Trapezoidal integral from the first gate; nulls count as zero."""
    w = along(keys)
    x = F.coalesce(v, F.lit(0.0))
    start = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (running_sum(x, keys) - x / 2 - start / 2) * dr


def pia_from_kdp(kdp: Column, dr: float, keys: list[str], gamma: float = 0.08) -> Column:
    """Two-way path-integrated attenuation."""
    return 2 * running_sum(gamma * kdp, keys) * dr


def phidp_from_kdp(kdp: Column, dr: float, keys: list[str]) -> Column:
    return 2 * cumtrapz(kdp, keys, dr)


def despeckle(v: Column, keys: list[str], n: int = 3) -> Column:
    """Null where all the other gates of the window of n are null; gates past the ends count as null."""
    if n not in (3, 5):
        raise ValueError("n must be 3 or 5")
    w = along(keys).rowsBetween(-(n // 2), n // 2)
    return F.when(F.count(v).over(w) != 1, v)


def reflected(v: Column, keys: list[str], k: int, last: Column) -> Column:
    """The value k gates further, mirrored at the ends of the ray without repeating the end."""
    w = along(keys)
    there = (F.lead(v, k) if k > 0 else F.lag(v, -k)).over(w) if k else v
    if k > 0:  # past the last gate: mirror
        back = F.coalesce(*[F.when(F.col("bin") + k == last + j, _shift(v, w, k - 2 * j)) for j in range(1, k + 1)], F.lit(None))
        return F.when(F.col("bin") + k > last, back).otherwise(there)
    if k < 0:
        fore = F.coalesce(*[F.when(F.col("bin") + k == -j, _shift(v, w, k + 2 * j)) for j in range(1, -k + 1)], F.lit(None))
        return F.when(F.col("bin") + k < 0, fore).otherwise(there)
    return there


def _shift(v: Column, w: Window, k: int) -> Column:
    return F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w) if k < 0 else v


def derivate_lanczos(v: Column, keys: list[str], winlen: int = 7) -> Column:
    """Slope per gate by the low-noise Lanczos differentiator with mirrored ends; null if any gate of the window is.

    Gates must be numbered from 0 without gaps.
    """
    m = winlen // 2
    last = F.max("bin").over(Window.partitionBy(*keys, "ray"))
    scale = 3.0 / (m * (m + 1) * (2 * m + 1))
    total = F.lit(0.0)
    for k in range(1, m + 1):
        total = total + k * scale * (reflected(v, keys, k, last) - reflected(v, keys, -k, last))
    # every gate of the window has to be there, the centre too
    return F.when(v.isNotNull(), total)


def finite_difference(v: Column, keys: list[str], winlen: int = 7) -> Column:
    """Difference of the window's ends over its length, with mirrored ends."""
    last = F.max("bin").over(Window.partitionBy(*keys, "ray"))
    return (reflected(v, keys, winlen // 2, last) - reflected(v, keys, -(winlen // 2), last)) / winlen


def derivate_regression(v: Column, keys: list[str], winlen: int = 7, min_periods: int | None = None) -> Column:
    """Slope per gate by least squares over the valid gates of a window with mirrored ends; null with fewer than min_periods.

    With all gates valid this is the Lanczos differentiator. Gates must be numbered from 0 without gaps.
    """
    last = F.max("bin").over(Window.partitionBy(*keys, "ray"))
    shifts = range(-(winlen // 2), winlen // 2 + 1)
    near = [reflected(v, keys, k, last) for k in shifts]
    n = sum((y.isNotNull().cast("int") for y in near), F.lit(0))
    add = lambda f: sum((F.coalesce(f(k, y), F.lit(0.0)) for k, y in zip(shifts, near, strict=True)), F.lit(0.0))
    sx, sxx = add(lambda k, y: F.when(y.isNotNull(), float(k))), add(lambda k, y: F.when(y.isNotNull(), float(k * k)))
    slope = F.try_divide(n * add(lambda k, y: y * k) - sx * add(lambda k, y: y), n * sxx - sx * sx)
    return F.when(n >= (winlen // 2 + 1 if min_periods is None else min_periods), slope)


def kdp_from_phidp(phi: Column, keys: list[str], dr: float = 1.0, winlen: int = 7, fill: bool = True) -> Column:
    """Half the slope of the phase over range; ``fill`` takes windows with missing gates too."""
    return (derivate_regression(phi, keys, winlen) if fill else derivate_lanczos(phi, keys, winlen)) / 2 / dr


def phidp_kdp_iterated(df: DataFrame, phi: str, keys: list[str], dr: float, speckle: int = 5, winlen: int = 7, rounds: int = 2, low: float = -2.0, high: float = 20.0, wrap: float = -20.0) -> DataFrame:
    """Adds ``phidp`` and ``kdp``: despeckled and unfolded phase, cleaned of impossible slopes, integrated and derived again.

    All steps are windows along the ray, so they share one shuffle.
    """
    kept = df.columns
    d = df.withColumn("__p", despeckle(F.col(phi), keys, speckle))
    d = d.withColumn("__k", finite_difference(F.col("__p"), keys, winlen) / 2 / dr)
    d = d.withColumn("__p", unfold_phi(F.col("__p"), F.col("__k"), keys, wrap, winlen))
    d = d.withColumn("__p", F.when(F.col("__p") <= 360, F.col("__p")))
    d = d.withColumn("__k", kdp_from_phidp(F.col("__p"), keys, dr, winlen))
    d = d.withColumn("__k", F.when((F.col("__k") > low) & (F.col("__k") < high), F.col("__k")).otherwise(0.0))
    for _ in range(rounds):
        d = d.withColumn("__p", phidp_from_kdp(F.col("__k"), dr, keys)).withColumn("__k", kdp_from_phidp(F.col("__p"), keys, dr, winlen))
    return d.select(*kept, F.col("__p").alias("phidp"), F.col("__k").alias("kdp"))


def gradient(v: Column, keys: list[str]) -> Column:
    """Central differences, one-sided at the ends."""
    w = along(keys)
    up, down = F.lead(v).over(w), F.lag(v).over(w)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, up - v).when(last, v - down).otherwise((up - down) / 2)


def fill_linear(v: Column, keys: list[str]) -> Column:
    """Linear interpolation of nulls along the ray; 0 beyond the outermost values and on rays that have fewer than two."""
    before = along(keys).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "ray").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # backwards: Spark goes through an open following frame anew for each row
    at = F.when(v.isNotNull(), F.col("bin"))
    v0, b0 = F.last(v, True).over(before), F.last(at, True).over(before)
    v1, b1 = F.last(v, True).over(after), F.last(at, True).over(after)
    return F.coalesce(v, v0 + (v1 - v0) * F.try_divide(F.col("bin") - b0, b1 - b0), F.lit(0.0))


def unfold_phi(phi: Column, kdp: Column, keys: list[str], th: float = -20.0, winlen: int = 7) -> Column:
    """Adds 360 beyond the first gate whose kdp is below th, and takes it back near there where it overshoots.

    As soon as any ray of the sweep has such a gate, rays without one are treated at their last gate.
    """
    ray = Window.partitionBy(*keys, "ray")
    wrap = F.coalesce(F.min(F.when(kdp < th, F.col("bin"))).over(ray), F.max("bin").over(ray))
    top = F.max(phi).over(ray)
    up = F.when(F.col("bin") > wrap, phi + 360).otherwise(phi)
    return F.when((F.col("bin") <= wrap + winlen) & (up > top + 180), up - 360).otherwise(up)


def with_neighbours(df: DataFrame, value: str, keys: list[str], n_rays: int) -> DataFrame:
    """``df`` with ``nb``: the 3 x 3 values around each gate as an array by (ray - 1, 0, 1) x (bin - 1, 0, 1).

    Rays are cyclic, ranges are not. Each gate is sent to the three rays that see it and to its three
    range neighbours by windows, so one shuffle on (keys, ray) does.
    """
    seen = df.select(*keys, "ray", "bin", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("dr"), F.col(value).alias("v"))
    seen = seen.select(*keys, F.pmod(F.col("ray") - F.col("dr"), F.lit(n_rays)).alias("ray"), "bin", F.when(F.col("v").isNotNull(), F.struct("dr", "v")).alias("s"))
    stacked = seen.groupBy(*keys, "ray", "bin").agg(*[F.max(F.when(F.col("s.dr") == k, F.col("s.v"))).alias(f"r{k + 1}") for k in (-1, 0, 1)])
    w = along(keys)
    near = lambda k, c: F.when(F.lag("bin", -c).over(w) == F.col("bin") + c, F.lag(f"r{k + 1}", -c).over(w)) if c else F.col(f"r{k + 1}")
    nb = stacked.select(*keys, "ray", "bin", F.array(*[near(k, c) for k in (-1, 0, 1) for c in (-1, 0, 1)]).alias("nb"))
    return df.join(nb, [*keys, "ray", "bin"])


def texture(df: DataFrame, value: str, keys: list[str], n_rays: int = 360) -> DataFrame:
    """Root mean squared difference to the valid ones of the eight neighbours."""
    n = with_neighbours(df, value, keys, n_rays)
    around = [F.col("nb")[i] for i in range(9) if i != 4]
    total = sum((F.coalesce(F.pow(a - F.col(value), F.lit(2.0)), F.lit(0.0)) for a in around), F.lit(0.0))
    count = sum((a.isNotNull().cast("int") for a in around), F.lit(0))
    return n.withColumn("texture", F.when(F.col(value).isNotNull(), F.sqrt(F.try_divide(total, count)))).drop("nb")


def z_to_r_enhanced(df: DataFrame, z: str, keys: list[str], n_rays: int = 360) -> DataFrame:
    """Adds ``si`` (shower index) and ``rr``: three-part Z-R relation by the index, fixed parts above 36.5 and 44 dBZ.

    The index is the mean absolute difference in dB between neighbours of the 3 x 3 window along both axes.
    """
    d = df.withColumn("__db", decibel(z))
    n = with_neighbours(d, "__db", keys, n_rays)
    nb = lambda r, b: F.col("nb")[(r + 1) * 3 + b + 1]
    diff = lambda a, b: F.coalesce(F.abs(a - b), F.lit(0.0))
    along_range = sum((diff(nb(r, b), nb(r, b + 1)) for r in (-1, 0, 1) for b in (-1, 0)), F.lit(0.0))
    across = sum((diff(nb(r, b), nb(r + 1, b)) for b in (-1, 0, 1) for r in (-1, 0)), F.lit(0.0))
    ray = Window.partitionBy(*keys, "ray")
    edge = (F.col("bin") == F.min("bin").over(ray)) | (F.col("bin") == F.max("bin").over(ray))
    db = F.col("__db")
    si = F.when(db >= 36.5, -1.0).otherwise((along_range + across) / F.when(edge, 7.0).otherwise(12.0))
    out = n.withColumn("si", si)
    s = F.col("si")
    rr = (
        F.when(db > 44, z_to_r(z, 77.0, 1.9)).when(db >= 36.5, z_to_r(z, 200.0, 1.6))
        .when((s >= 3.5) & (s <= 7.5), z_to_r(z, 200.0, 1.6)).when((s > 7.5) & (s < 36.5), z_to_r(z, 320.0, 1.4)).when(s < 3.5, z_to_r(z, 125.0, 1.4)).otherwise(0.0)
    )
    return out.withColumn("rr", rr).drop("nb", "__db")


def similar_neighbours(df: DataFrame, value: str, keys: list[str], n_rays: int, n_bins: int, wsize: int = 5, tr1: float = 6.0) -> DataFrame:
    """Adds ``similar``: how many gates of the window, itself excepted, are above the gate's value minus tr1.

    Rays wrap; the first and last wsize // 2 ranges get wsize squared. A gate goes to the rays around its own, what is near along the
    range comes from windows. The gates of a ray must have different bins.
    """
    h = wsize // 2
    sent = df.select(*keys, "ray", "bin", F.col(value).alias("v"), F.explode(F.sequence(F.lit(-h), F.lit(h))).alias("da")).select(*keys, F.pmod(F.col("ray") + F.col("da"), F.lit(n_rays)).alias("ray"), "bin", "da", "v")
    columns = [f"__{k}" for k in range(wsize)]
    stacked = sent.groupBy(*keys, "ray", "bin").agg(*[F.max(F.when(F.col("da") == k - h, F.col("v"))).alias(c) for k, c in enumerate(columns)])
    w = along(keys)
    # Bins differ, so those at most h away are among the h rows before and behind.
    ahead = lambda c, k: F.when(F.abs(F.lag("bin", -k).over(w) - F.col("bin")) <= h, F.lag(c, -k).over(w)) if k else F.col(c)
    hit = lambda v: F.coalesce((F.col(f"__{h}") - v < tr1).cast("long"), F.lit(0).cast("long"))
    hits = stacked.select(*keys, "ray", "bin", (sum((hit(ahead(c, k)) for c in columns for k in range(-h, h + 1)), F.lit(0)) - 1).alias("__n"))
    edge = (F.col("bin") < h) | (F.col("bin") >= n_bins - h)
    return df.join(hits.hint("merge"), [*keys, "ray", "bin"], "left").withColumn("similar", F.when(edge, F.lit(wsize * wsize).cast("long")).otherwise(F.coalesce("__n", F.lit(-1).cast("long")))).drop("__n")


# system phase


def phi_windows(df: DataFrame, phi: str, keys: list[str], n: int) -> DataFrame:
    """Per ray: the first and the last of the densest windows of n gates, their medians and the count.

    Columns: first_end, last_end (bins), most, first and last (median phase). Rays shorter than n give nothing.
    """
    w = along(keys)
    d = df.withColumn("__n", F.when(F.row_number().over(w) >= n, F.count(phi).over(w.rowsBetween(-(n - 1), 0))))
    densest = d.where("__n is not null").groupBy(*keys, "ray").agg(F.max("__n").alias("most"), F.min_by("bin", F.struct(-F.col("__n"), F.col("bin"))).alias("first_end"), F.max_by("bin", F.struct("__n", "bin")).alias("last_end"))
    j = df.join(densest, [*keys, "ray"])
    within = lambda end: F.when((F.col("bin") > F.col(end) - n) & (F.col("bin") <= F.col(end)), F.col(phi))
    return j.groupBy(*keys, "ray", "most", "first_end", "last_end").agg(F.median(within("first_end")).alias("first"), F.median(within("last_end")).alias("last"))


def system_phase(rays: DataFrame, value: str, keys: list[str], n_lowest: int = 30) -> DataFrame:
    """Median of the lowest ray values of each sweep."""
    w = Window.partitionBy(*keys).orderBy(F.col(value), "ray")
    lowest = rays.where(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n_lowest)
    return lowest.groupBy(*keys).agg(F.median(value).alias("sysphi"))


def first_valid_phase(df: DataFrame, phi: str, keys: list[str], n: int = 10) -> DataFrame:
    """Median of the first n valid gates of each ray that has n."""
    w = along(keys)
    v = df.where(F.col(phi).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    return v.groupBy(*keys, "ray").agg(F.median(phi).alias("sysphi_ray"), F.count("*").alias("valid_bins")).where(F.col("valid_bins") == n)


def phase_histogram(df: DataFrame, phi: str, keys: list[str], low: float = -180.0, high: float = 180.0, step: float = 0.1, window: int = 11, threshold: float = 0.5) -> DataFrame:
    """Per ray: ``peak``, the class where the smoothed histogram of the phase is greatest, and ``first``, the lowest above the threshold's share of it.

    Classes are named by their centres. Only classes near a value are counted, so the work follows the gates and
    not the classes. Rays without a value away from the ends give nothing.
    """
    h, n = window // 2, round((high - low) / step) - 1
    at = F.floor((F.col(phi) - low) / step + 1e-9)
    seen = df.where(F.col(phi).isNotNull()).select(*keys, "ray", at.alias("b")).where((F.col("b") >= 0) & (F.col("b") < n)).groupBy(*keys, "ray", "b").agg(F.count("*").alias("n"))
    smooth = seen.select(*keys, "ray", "n", F.explode(F.sequence(F.col("b") - h, F.col("b") + h)).alias("b")).where((F.col("b") >= h) & (F.col("b") < n - h)).groupBy(*keys, "ray", "b").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(*keys, "ray"))
    centre = low + (F.col("b") + 0.5) * step
    return smooth.withColumn("__top", top).groupBy(*keys, "ray").agg(F.min(F.when(F.col("n") == F.col("__top"), centre)).alias("peak"), F.min(F.when(F.col("n") > threshold * F.col("__top"), centre)).alias("first"))


def specific_attenuation_zphi(df: DataFrame, phi: str, dbz: str, keys: list[str], alpha: float | list[float], b: float, n: int, dr: float = 1.0) -> DataFrame:
    """Adds ``ah`` from reflectivity, scaled so that the attenuation between the densest windows of n gates agrees with the phase.

    A falling or missing phase difference counts as 1e-4, none at all gives zero; gates outside the windows as 1e-4 of linear
    reflectivity. With several alphas there is a row for each, with the column ``alpha``. Rays shorter than n give nothing.
    """
    kept = df.columns
    spans = phi_windows(df, phi, keys, n).select(*keys, "ray", (F.col("first_end") - (n - 1)).alias("__start"), F.col("last_end").alias("__stop"), (F.col("last") - F.col("first")).alias("__d"))
    d = df.join(spans, [*keys, "ray"])
    inside = F.col("bin").between(F.col("__start"), F.col("__stop")) & F.col(dbz).isNotNull()
    d = d.withColumn("__za", F.pow(F.when(inside, F.pow(F.lit(10.0), F.col(dbz) / 10.0)).otherwise(1e-4), F.lit(b)))
    d = d.withColumn("__x", 0.46 * b * cumtrapz(F.col("__za"), keys, dr))
    ray = Window.partitionBy(*keys, "ray")
    d = d.withColumn("__i", F.max("__x").over(ray) - F.col("__x"))
    d = d.withColumn("__i1", F.max(F.when(F.col("bin") == F.col("__start"), F.col("__i"))).over(ray))
    if isinstance(alpha, list):
        d, kept, by = d.withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in alpha]))), [*kept, "alpha"], F.col("alpha")
    else:
        by = F.lit(float(alpha))
    f = F.pow(F.lit(10.0), 0.1 * b * by * F.when(F.col("__d") >= 0, F.col("__d")).otherwise(1e-4)) - 1
    ah = F.try_divide(F.col("__za"), F.try_divide(F.col("__i1"), f) + F.col("__i"))
    return d.select(*kept, F.when((f == 0) & (F.col("__i1") > 0), 0.0).otherwise(ah).alias("ah"))


# recurrences, on packed rays


def packed(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One row per ray with its values in an array by bin."""
    return df.groupBy(*keys, "ray").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def forward(z: list[float | None], a: float, b: float, dr: float) -> list[float | None]:
    """Two-way attenuation up to each gate of one ray; without a value all gates beyond have none. Too large a sum is infinite."""
    p, out = 0.0, [0.0]
    add = out.append
    for k, v in enumerate(z[:-1], 1):
        if v is None:
            return out + [None] * (len(z) - k)
        try:
            p = p + a * (10.0 ** ((v + p) / 10.0)) ** b * 2.0 * dr
        except OverflowError:
            p = math.inf
        add(p)
    return out


def attenuation_forward(values: Column, a: float = 1.67e-4, b: float = 0.7, gate_length: float = 1.0) -> Column:
    """Two-way attenuation up to each gate of an array of dBZ, gate by gate.

    Spark can continue an array only by a copy of it, so the loop runs in Python, on one ray at a time.
    """

    @F.arrow_udf("array<double>")
    def run(rays: pa.Array) -> pa.Array:
        return pa.array((None if r is None else forward(r, a, b, gate_length) for r in (x.as_py() for x in rays)), pa.list_(pa.float64()))

    return run(values.cast("array<double>"))


def attenuation_overflow(values: Column, pia: Column, threshold: float = 59.0, mode: str = "nan") -> Column:
    """The attenuation where the corrected value stays within the threshold; null or zero ("zero") beyond, an error with "except"."""
    bad = lambda z, p, i: (i > 0) & (z + p > threshold)
    other = {"nan": F.lit(None).cast("double"), "zero": F.lit(0.0)}
    pairs = F.zip_with(values, pia, lambda z, p: F.struct(z.alias("z"), p.alias("p")))
    if mode == "warn":
        return pia
    fail = F.raise_error(F.lit("corrected signal over threshold")).cast("double") if mode == "except" else other[mode]
    return F.transform(pairs, lambda s, i: F.when(bad(s["z"], s["p"], i), fail).otherwise(s["p"]))


def radome_attenuation(df: DataFrame, dbz: str, keys: list[str], frequency: float = 5.64, hydrophobicity: float = 0.165, n_r: int = 2) -> DataFrame:
    """Attenuation by a wet radome for each sweep, from the mean of its first n_r gates."""
    rate = z_to_r(F.pow(F.lit(10.0), F.avg(dbz) / 10.0))
    return df.where(F.col("bin") < n_r).groupBy(*keys).agg((2 * hydrophobicity * rate * F.pow(F.tanh(F.lit(frequency / 10.0)), F.lit(2.0))).alias("k"))


def bright_band_ratio(df: DataFrame, height: str, width: str, quality: str, z: str, keys: list[str], good: int = 1) -> DataFrame:
    """Adds ``ratio``: where a gate's height lies between bottom (0) and top (1) of the melting layer, from the sweep's medians.

    Only gates whose quality equals ``good`` and whose height and width are above zero count for the medians.
    """
    ok = (F.col(quality) == good) & (F.col(height) > 0) & (F.col(width) > 0)
    m = df.where(ok).groupBy(*keys).agg(F.median(height).alias("__h"), F.median(width).alias("__w"))
    low = F.col("__h") - F.col("__w") / 2
    return df.join(m, keys, "left").withColumn("ratio", F.try_divide(F.col(z) - low, F.col("__w"))).drop("__h", "__w")


def histogram_cut(df: DataFrame, value: str, upper: float = 0.01, lower: float = 0.01, bins: int = 50, rounds: int = 100) -> DataFrame:
    """Adds ``mask``: 1 above and 2 below the bounds that a histogram is cut to, else 0; null values give null.

    Each round counts the values between the bounds in equal classes (a table of ``bins`` rows goes to the
    driver). From the fullest class outwards the first class with less than the given share of it becomes the
    new bound, with its far edge. A bound that moved by one or less is settled; the search ends when both are.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    low_open = high_open = low is not None
    for _ in range(rounds):
        if not (low_open or high_open) or high - low <= 0:
            break
        step = (high - low) / bins
        at = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1))
        n = {r["b"]: r["n"] for r in df.where(F.col(value).between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect()}
        most = max(n.values())
        peak = min(b for b, k in n.items() if k == most)
        down = next((b for b in range(peak, -1, -1) if n.get(b, 0) < lower * most), 0)
        up = next((b for b in range(peak, bins) if n.get(b, 0) < upper * most), bins - 1)
        new_low, new_high = low + step * down if low_open else low, low + step * (up + 1) if high_open else high
        low_open, high_open = abs(new_low - low) > 1, abs(new_high - high) > 1
        low, high = new_low, new_high
    v = F.col(value)
    return df.withColumn("mask", F.when(v.isNull() | F.lit(low is None), None).when(v > high, 1).when(v < low, 2).otherwise(0))
