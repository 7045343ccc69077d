"""Geodesics on the WGS84 ellipsoid, by Vincenty's series, on whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbusframe.functions.georef import WGS84_A, WGS84_B
from nimbusframe.functions.moments import c

FLAT = (WGS84_A - WGS84_B) / WGS84_A


def _series(cos2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u2 = cos2 * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _correction(b, sin_s, cos_s, cos_2m):
    return b * sin_s * (cos_2m + b / 4 * (cos_s * (2 * cos_2m**2 - 1) - b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))


def _longitude(lam, sin_a, cos2, s, sin_s, cos_s, cos_2m):
    k = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    return (1 - k) * FLAT * sin_a * (s + k * sin_s * (cos_2m + k * cos_s * (2 * cos_2m**2 - 1)))


def direct(lon, lat, azimuth, distance, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees of the point at a distance in m from another, in the direction of an azimuth."""
    lon, lat, az, d = (np.asarray(x, dtype=float) for x in (lon, lat, azimuth, distance))
    a1, u1 = np.radians(az), np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    s1 = np.arctan2(np.tan(u1), np.cos(a1))
    sin_a = np.cos(u1) * np.sin(a1)
    cos2 = 1 - sin_a**2
    big_a, big_b = _series(cos2)
    s = first = d / (WGS84_B * big_a)
    for _ in range(rounds):
        cos_2m = np.cos(2 * s1 + s)
        s = first + _correction(big_b, np.sin(s), np.cos(s), cos_2m)
    sin_s, cos_s, cos_2m = np.sin(s), np.cos(s), np.cos(2 * s1 + s)
    t = np.sin(u1) * sin_s - np.cos(u1) * cos_s * np.cos(a1)
    lat2 = np.arctan2(np.sin(u1) * cos_s + np.cos(u1) * sin_s * np.cos(a1), (1 - FLAT) * np.hypot(sin_a, t))
    lam = np.arctan2(sin_s * np.sin(a1), np.cos(u1) * cos_s - np.sin(u1) * sin_s * np.cos(a1))
    return lon + np.degrees(lam - _longitude(lam, sin_a, cos2, s, sin_s, cos_s, cos_2m)), np.degrees(lat2)


def inverse(lon1, lat1, lon2, lat2, rounds: int = 60) -> np.ndarray:
    """Distance in m between points; NaN where the series doesn't settle (nearly opposite points)."""
    lon1, lat1, lon2, lat2 = (np.asarray(x, dtype=float) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    gap = lam = np.radians(lon2 - lon1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
            cos2 = 1 - sin_a**2
            cos_2m = np.where(cos2 == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1, cos2))
            before, lam = lam, gap + _longitude(lam, sin_a, cos2, s, sin_s, cos_s, cos_2m)
        big_a, big_b = _series(cos2)
        out = WGS84_B * big_a * (s - _correction(big_b, sin_s, cos_s, cos_2m))
    return np.where(np.abs(lam - before) < 1e-10, out, np.nan)


def destination(lon, lat, azimuth, distance) -> Column:
    """Struct of lon and lat of the point reached; null if any part is null."""

    @F.pandas_udf("lon double, lat double")
    def go(lon: pd.Series, lat: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
        x, y = direct(lon, lat, azimuth, distance)
        return pd.DataFrame({"lon": x, "lat": y})

    parts = [c(v).cast("double") for v in (lon, lat, azimuth, distance)]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return F.when(known, go(*parts))


def ground_distance(lon1, lat1, lon2, lat2) -> Column:
    """Length of the geodesic between two points in m; null if any part is null or the points are nearly opposite."""

    @F.pandas_udf("double")
    def go(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(inverse(a, b, x, y))

    return F.nanvl(go(*[c(v).cast("double") for v in (lon1, lat1, lon2, lat2)]), F.lit(None))


def gate_lonlat(r, phi, theta, site: tuple[float, float, float]) -> Column:
    """Struct of lon and lat of a radar gate: its distance along the ground, in its azimuth from the site (lon, lat, altitude)."""
    from nimbusframe.functions.georef import bin_altitude, site_distance

    z = bin_altitude(r, theta, site[2])
    return destination(F.lit(site[0]), F.lit(site[1]), phi, site_distance(r, theta, z))


def meters_to_degrees(dx: float, dy: float, lon: float = 0.0, lat: float = 0.0) -> tuple[float, float]:
    """Steps in degrees of longitude and latitude that go dx m to the east and dy m to the north."""
    east, _ = direct(lon, lat, 90.0, dx)
    _, north = direct(lon, lat, 0.0, dy)
    return float(east) - lon, float(north) - lat
