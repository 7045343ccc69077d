"""Sweep operators, classes and polygon clipping against plain versions and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbusframe.functions import georef
from nimbusframe.operators import classes, rays, spatial, sweeps


def flooded(on):
    """Cells by flood fill."""
    number, n = np.zeros(on.shape, dtype=int), 0
    for start in zip(*np.nonzero(on), strict=True):
        if number[start]:
            continue
        n += 1
        stack = [start]
        while stack:
            i, j = stack.pop()
            if 0 <= i < on.shape[0] and 0 <= j < on.shape[1] and on[i, j] and not number[i, j]:
                number[i, j] = n
                stack += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return number


@pytest.mark.parametrize("density", [0.0, 0.2, 0.45, 0.7, 1.0])
def test_cells_match_flood_fill(density):
    on = np.random.default_rng(1).random((40, 30)) < density
    got, want = sweeps.cell_numbers(on), flooded(on)
    pairs = set(zip(got.ravel().tolist(), want.ravel().tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert ((got > 0) == on).all()


def test_area_over_border():
    v = np.zeros((7, 7))
    v[1:6, 1:6] = 10  # 25 gates, 16 at the border
    ratio = sweeps.cell_ratio(v, 0.0)
    assert ratio[3, 3] == ratio[1, 1] == 25 / 16
    assert ratio[0, 0] == -24 / 16


def test_rain_cells_of_several_sweeps(spark):
    rows = [(s, i, j, None if (s, i, j) == (1, 2, 2) else float(s == 0 and i < 2)) for s in range(2) for i in range(4) for j in range(5)]
    got = {(r.s, r.ray, r.bin): r.ratio for r in sweeps.rain_cells(spark.createDataFrame(rows, "s int, ray int, bin int, v double"), "v", ["s"]).collect()}
    assert got[0, 0, 0] == 1.0 and got[0, 3, 3] == -1.0
    assert got[1, 2, 2] == 1.0 and got[1, 0, 0] == -19.0


def test_long_runs():
    f = lambda s: np.array([c == "1" for c in s])
    assert (sweeps.long_runs(f("1101110000011"), 4) == f("1100000000011")).all()
    assert (sweeps.long_runs(f("1101110000011"), 3) == f("1101110000011")).all()
    assert sweeps.long_runs(f("1111"), 3).all() and not sweeps.long_runs(f("11"), 3).any()


def test_bisection_meets_the_reference():
    z = np.random.default_rng(2).uniform(10, 45, (6, 60))
    ref = sweeps.forward(z, 7e-5, 0.7, 1.0)[:, -1]
    pia, a, b = sweeps.bisected(z, ref, 1.67e-4, 2.33e-5, 0.7, 1.0, "difference", 0.01, 30)
    assert np.abs(pia[:, -1] - ref).max() <= 0.01
    assert (b == 0.7).all()
    for k in range(6):
        assert pia[k] == pytest.approx(sweeps.forward(z[k : k + 1], a[k], b[k], 1.0)[0])


def test_constraints_lower_coefficients_in_wide_sectors_only(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 20, (40, 50))
    z[5:20] += 27  # wide
    z[30:32] += 27  # narrow
    pia, a, b = sweeps.constrained(z, 1.67e-4, 2.33e-5, 4, 0.7, 0.65, 6, 1.0, None, 2.0, 10)
    plain = sweeps.forward(z, 1.67e-4, 0.7, 1.0)
    assert (plain[5:20, -1] > 2).all() and (plain[30:32, -1] > 2).all()
    assert (a[5:20] < 1.67e-4).all() and (pia[5:20, -1] <= 2).any()
    dry = np.r_[0:5, 20:30, 32:40]
    assert pia[dry] == pytest.approx(plain[dry])
    assert np.abs(pia[30:32, -1] - np.interp([30, 31], [29, 32], plain[[29, 32], -1])).max() < 0.3
    df = spark.createDataFrame([(0, i, j, float(z[i, j])) for i in range(40) for j in range(50)], "s int, ray int, bin int, z double")
    got = {r.ray: r for r in sweeps.constrained_attenuation(df, "z", ["s"], most_pia=2.0).collect()}
    assert np.array([got[k].pia for k in range(40)]) == pytest.approx(pia)


def test_memberships_and_dry_class(spark):
    table = spark.createDataFrame([(0, "z", 0.0, 0.0, 1.0, 2.0, 3.0), (1, "z", 0.0, 1.0, 2.0, 3.0, 4.0)], "hmc long, obs string, lower double, p1 double, p2 double, p3 double, p4 double")
    obs = spark.createDataFrame([(1, "z", 0.5, 5.0), (2, "z", 2.5, 5.0), (3, "z", 9.0, 5.0), (4, "z", 1.0, 50.0), (5, "z", None, 5.0)], "k int, obs string, value double, idp double")
    m = classes.memberships(obs, table, ["k"], 0.0, 10.0, 1)
    assert {(r.k, r.hmc): r.m for r in m.collect()} == {(1, 0): 0.5, (1, 1): 0.0, (2, 0): 0.5, (2, 1): 1.0, (3, 0): 0.0, (3, 1): 0.0, (4, 0): 0.0, (4, 1): 0.0, (5, 0): 0.0, (5, 1): 0.0}
    p = classes.class_probability(m, spark.createDataFrame([("z", 2.0)], "obs string, weight double"), ["k"])
    ranking = {r.k: [(s.p, s.hmc) for s in r.ranking] for r in classes.classified(p, ["k"]).collect()}
    assert ranking[2] == [(0.0, 2), (0.5, 0), (1.0, 1)]
    assert ranking[3] == [(1.0, 2)] * 3


def test_overlap_area_of_polygons(spark):
    shape = "array<struct<x:double,y:double>>"
    hook = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 4.0), (3.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0), (0.0, 0.0)]  # a U, clockwise or not
    cell = [(-1.0, 2.0), (5.0, 2.0), (5.0, 3.0), (-1.0, 3.0), (-1.0, 2.0)]
    kite = [(2.0, -1.0), (5.0, 2.0), (2.0, 5.0), (-1.0, 2.0), (2.0, -1.0)]
    far = [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0), (10.0, 10.0)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    cases = [(hook, cell, 2.0), (hook[::-1], cell, 2.0), (square, kite, 14.0), (square, far, 0.0), (square, square, 16.0)]
    df = spark.createDataFrame(cases, f"ring {shape}, cell {shape}, want double")
    for r in df.select("want", georef.overlap_area(F.col("ring"), F.col("cell")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_phase_iteration_finds_the_slope(spark):
    kdp = np.where((np.arange(120) > 20) & (np.arange(120) < 90), 1.5, 0.0)
    phi = 2 * np.cumsum(kdp) * 0.5 + np.random.default_rng(5).normal(0, 0.2, 120)
    rows = [(0, j, None if j % 17 == 3 else float(phi[j])) for j in range(120)]
    got = rays.phidp_kdp_iterated(spark.createDataFrame(rows, "ray int, bin int, phi double"), "phi", [], 0.5).orderBy("bin").collect()
    k = np.array([r.kdp for r in got])
    assert np.abs(k[30:80] - 1.5).max() < 0.3
    assert np.abs(k[:10]).max() < 0.3
    assert [r.bin for r in got] == list(range(120))


def test_polar_gaps_take_the_nearest_gate(spark):
    rng = np.random.default_rng(6)
    v = rng.random((36, 8))
    gap = rng.random(v.shape) < 0.3
    df = spark.createDataFrame([(i, j, None if gap[i, j] else float(v[i, j])) for i in range(36) for j in range(8)], "ray long, bin long, v double")
    got = {(r.ray, r.bin): r.v for r in spatial.fill_polar(df, "v", 36).collect()}
    i, j = np.indices(v.shape)
    x, y = np.cos(np.radians(i * 10)) * (j + 0.5), np.sin(np.radians(i * 10)) * (j + 0.5)
    for a, b in zip(*np.nonzero(gap), strict=True):
        d = np.where(gap, np.inf, (x - x[a, b]) ** 2 + (y - y[a, b]) ** 2)
        assert got[a, b] in v[d <= d.min() + 1e-9]
    assert all(got[a, b] == v[a, b] for a, b in zip(*np.nonzero(~gap), strict=True))


def test_drift_kriging_follows_a_linear_drift(spark):
    rng = np.random.default_rng(7)
    src, trg = rng.uniform(0, 10, (30, 3)), rng.uniform(0, 10, (12, 3))
    s = spark.createDataFrame([(k, *map(float, r), float(2 + 3 * r[2])) for k, r in enumerate(src)], "src_id long, x double, y double, drift double, v double")
    t = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(trg)], "trg_id long, x double, y double, drift double")
    near = spatial.knn(t, s, 8)
    for r in spatial.ordinary_kriging(near, s, "v", 1.0, 5.0, t).collect():
        assert r.value == pytest.approx(2 + 3 * trg[r.trg_id][2], abs=1e-6)
