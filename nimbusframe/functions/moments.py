"""Column functions for radar moments: transformations, Z-R relations, dual-polarisation, quality, membership.

All take and return Columns, stay in generated code, and give null where the input is null
or the result is undefined (logarithm of zero or less, division by zero).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def valid(x: Column | str, minval: float | None = None, maxval: float | None = None, sentinels: tuple = (-99.0, 99.0, -9999.0)) -> Column:
    """The value if it is a number, no sentinel and within the limits, else null."""
    v = finite(c(x).cast("double"))
    ok = ~v.isin(*sentinels)
    if minval is not None:
        ok &= v >= minval
    if maxval is not None:
        ok &= v <= maxval
    return F.when(ok, v)


# transformations


def rvp_to_dbz(x):
    return c(x) * 0.5 - 32.5


def decibel(x):
    v = c(x)
    return F.when(v > 0, 10.0 * F.log10(v))


def idecibel(x):
    return F.pow(F.lit(10.0), c(x) / 10.0)


def r_to_depth(rate, seconds):
    """Depth of a rate per hour over an interval in seconds."""
    return c(rate) * c(seconds) / 3600.0


def kdp_to_r(kdp, frequency: float, a: float = 129.0, b: float = 0.85):
    v = c(kdp)
    return F.signum(v) * a * F.pow(F.abs(v) / frequency, F.lit(b))


def si_to_kmh(v):
    return c(v) * 3.6


def si_to_mph(v):
    return c(v) * 3600.0 / 1609.344


def si_to_kts(v):
    return c(v) * 3600.0 / 1852.0


def kmh_to_si(v):
    return c(v) / 3.6


def mph_to_si(v):
    return c(v) * 1609.344 / 3600.0


def kts_to_si(v):
    return c(v) * 1852.0 / 3600.0


def polynomial(x, coefficients: list[float]):
    """Sum of coefficients[i] * x**i, by Horner's rule."""
    v, out = c(x), F.lit(float(coefficients[-1]))
    for k in reversed(coefficients[:-1]):
        out = out * v + k
    return out


# Z-R relations


def z_to_r(z, a: float = 200.0, b: float = 1.6):
    return F.pow(c(z) / a, F.lit(1.0 / b))


def r_to_z(r, a: float = 200.0, b: float = 1.6):
    return a * F.pow(c(r), F.lit(b))


# dual-polarisation


def depolarization(zdr, rho):
    """Depolarisation ratio in dB from ZDR in dB and the correlation coefficient."""
    lin = idecibel(zdr)
    m = 2 * c(rho) * F.sqrt(lin)
    return decibel(F.try_divide(1 + lin - m, 1 + lin + m))


def rhohv_noise_correction(rho, snr):
    return c(rho) * F.sqrt(1.0 + 1.0 / idecibel(snr))


# quality


def pulse_volume(ranges, h: float, theta: float):
    return math.pi * h * F.pow(c(ranges), F.lit(2.0)) * math.tan(math.radians(theta / 2.0)) ** 2


def half_power_radius(r, beam_width: float):
    return c(r) * math.radians(beam_width) / 2.0


def beam_block_frac(terrain, beam, radius):
    """Share of the beam's cross section below the terrain: 0 when clear, 1 when blocked."""
    a, y = c(radius), c(terrain) - c(beam)
    s = F.try_divide(y, a)
    inside = (s * F.sqrt(F.greatest(a * a - y * y, F.lit(0.0))) + a * F.asin(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0))) + math.pi * a / 2) / (math.pi * a)
    return F.when(s < -1, 0.0).when(s > 1, 1.0).otherwise(inside)


def snr(dbz, range_m, noise_level: float, gas_attenuation: float):
    km = c(range_m) / 1000.0
    return F.when(km > 0, c(dbz) - 20 * F.log10(km) - noise_level - gas_attenuation * km)


# membership


def trapezoid(x, x1: float, x2: float, x3: float, x4: float):
    """Degree of membership: 1 in [x2, x3], falling to 0 at x1 and x4."""
    v = c(x)
    up = (v - x1) / (x2 - x1) if x2 != x1 else F.lit(1.0)
    down = (x4 - v) / (x4 - x3) if x4 != x3 else F.lit(1.0)
    return F.when(v.isNull(), None).when((v >= x2) & (v <= x3), 1.0).when((v > x1) & (v < x2), up).when((v > x3) & (v < x4), down).otherwise(0.0)


def no_rain_cloud(cloud, snow: bool = False, low: bool = False, cirrus: bool = False):
    """Whether a satellite cloud class is taken as free of precipitation."""
    codes = [1, 2] + [3, 4] * snow + [5, 6, 7] * low + [14, 18] * cirrus
    return c(cloud).isin(*codes)


def weighted_membership(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are not null, by weight; null if all are."""
    total = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    weight = sum((F.when(p.isNull(), 0.0).otherwise(w) for p, w in parts), F.lit(0.0))
    return F.try_divide(total, weight)


# covariance models of the distance h


def covariance(kind: str, h, sill: float = 1.0, rng: float = 1.0, **shape: float):
    v = c(h)
    match kind:
        case "nug":
            return F.when(v <= rng, F.lit(sill)).otherwise(0.0)
        case "exp":
            return sill * F.exp(-v / rng)
        case "sph":
            return F.when(v < rng, sill * (1.0 - 1.5 * v / rng + F.pow(v / rng, F.lit(3.0)) / 2.0)).otherwise(0.0)
        case "gau":
            return sill * F.exp(-F.pow(v / rng, F.lit(2.0)))
        case "lin":
            return F.when(v < rng, sill * (-v / rng + 1.0)).otherwise(0.0)
        case "pow":
            return sill - F.pow(v, F.lit(rng))
        case "cau":
            return sill * F.pow(1.0 + F.pow(v / rng, F.lit(shape.get("alpha", 1.0))), F.lit(-shape.get("beta", 1.0) / shape.get("alpha", 1.0)))
        case "mat":
            return matern(v, sill, rng, shape.get("nu", 0.5))
    raise ValueError(f"unknown covariance model {kind!r}")


def matern(h, sill: float = 1.0, rng: float = 1.0, nu: float = 0.5) -> Column:
    """Matern covariance; beyond a shape of 100 it is taken for Gaussian. The Bessel function comes from its integral over cosh."""
    if nu > 100:
        return covariance("gau", h, sill, rng)

    @F.pandas_udf("double")
    def value(h):
        t = np.linspace(0.0, 12.0, 3001)
        x = np.abs(h.to_numpy(dtype=float)) / rng * 2.0 * math.sqrt(nu)
        out = np.full(len(x), np.nan)
        for k in range(0, len(x), 512):
            z = x[k : k + 512, None]
            with np.errstate(over="ignore", invalid="ignore"):
                y = np.exp(-z * np.cosh(t)) * np.cosh(nu * t)
            weights = np.full(len(t), t[1])
            weights[[0, -1]] /= 2
            out[k : k + 512] = sill / (math.gamma(nu) * 2.0 ** (nu - 1.0)) * z[:, 0] ** nu * (y @ weights)
        return pd.Series(np.where(x == 0, sill, out))

    return F.nanvl(value(c(h).cast("double")), F.lit(None))


def covariogram(model: str, h) -> Column:
    """Covariance at the distance h by a model written as a sum, as in "0.5 Nug(0) + 2 Exp(20) + 1 Mat(10)^0.5 + 1 Cau(5)^1.5^2"."""
    names = {"Nug": "nug", "Lin": "lin", "Sph": "sph", "Exp": "exp", "Gau": "gau", "Pow": "pow", "Mat": "mat", "Cau": "cau"}
    parts = []
    for term in model.split("+"):
        m = re.fullmatch(r"\s*([\d.]+)\s+([A-Z][a-z]{2})\(([\d.]+)\)((?:\^[\d.]+)*)\s*", term)
        if not m or m[2] not in names:
            raise ValueError(f"can't read {term!r} as a covariance model")
        shape = [float(x) for x in m[4].split("^")[1:]]
        extra = {"Mat": ("nu",), "Cau": ("alpha", "beta")}.get(m[2], ())
        if len(shape) != len(extra):
            raise ValueError(f"{m[2]} takes {len(extra)} shape parameters")
        parts.append(covariance(names[m[2]], h, float(m[1]), float(m[3]), **dict(zip(extra, shape, strict=True))))
    return sum(parts[1:], parts[0])
