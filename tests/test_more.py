"""Geodesics, grids, rings, covariance strings, run-length products and the neighbour search on awkward points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbusframe.functions import geodesic, shapes
from nimbusframe.functions import moments as M
from nimbusframe.operators import grids, spatial, volumes
from nimbusframe.operators import rays as R
from nimbusframe.operators.classes import weather_probability
from nimbusframe.sources import binary


def test_geodesics_match_a_published_line():
    # Flinders Peak to Buninyong on an ellipsoid of nearly the same shape: 54 972 m at 306.868 degrees.
    lon, lat = geodesic.direct(144.42486789, -37.95103342, 306.86816, 54972.271)
    assert (float(lon), float(lat)) == pytest.approx((143.926496, -37.652821), abs=2e-5)
    assert float(geodesic.inverse(144.42486789, -37.95103342, lon, lat)) == pytest.approx(54972.271, abs=1e-3)
    assert float(geodesic.inverse(0.0, 0.0, 1.0, 0.0)) == pytest.approx(math.radians(1) * 6378137.0, abs=1e-3)  # along the equator
    assert np.isnan(geodesic.inverse(0.0, 0.0, 179.9, 0.1))  # nearly opposite: the series doesn't settle
    assert float(geodesic.inverse(3.0, 4.0, 3.0, 4.0)) == 0.0


def test_steps_in_degrees_come_back_as_metres():
    dlon, dlat = geodesic.meters_to_degrees(2000.0, 500.0, 9.0, 51.0)
    assert float(geodesic.inverse(9.0, 51.0, 9.0, 51.0 + dlat)) == pytest.approx(500.0, abs=1e-3)
    assert float(geodesic.inverse(9.0, 51.0, 9.0 + dlon, 51.0)) == pytest.approx(2000.0, abs=1e-2)


def test_gates_lie_at_their_ground_distance(spark):
    gates = grids.sweep_centroids(spark, 8, 5, 20000.0, 1.0).withColumn("p", geodesic.gate_lonlat("range", "azimuth", F.lit(1.0), (9.0, 51.0, 100.0)))
    rows = grids.georeference(gates, 100.0).select("gr", geodesic.ground_distance(F.lit(9.0), F.lit(51.0), "p.lon", "p.lat").alias("d")).collect()
    assert [r.d for r in rows] == pytest.approx([r.gr for r in rows], abs=1e-3)
    nothing = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert nothing.select(geodesic.ground_distance("a", "b", "b", "b").alias("d"), geodesic.destination("a", "b", "b", "b").alias("p")).first() == (None, None)


def test_composite_grid_corners(spark):
    corner = grids.composite_grid(spark).where("row = 0 and col = 0").first()
    assert (corner.x, corner.y) == pytest.approx((-523.4622, -4658.6447), abs=1e-4)
    assert grids.composite_grid(spark, 1100, 900, "edge").count() == 1101 * 901
    centre = grids.composite_grid(spark, 900, 900, "center").where("row = 450 and col = 450").first()
    assert (centre.x, centre.y) == pytest.approx((corner.x + 450.5, corner.y + 450.5))
    with pytest.raises(ValueError):
        grids.composite_grid(spark, 7, 7)


def test_covariance_strings(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (7.5,), (None,)], "h double")
    z = lambda h, nu, rng: h / rng * 2 * math.sqrt(nu)
    got = [r.v for r in df.select(M.covariogram("3 Mat(5)^1.5", "h").alias("v")).collect()]
    assert got[0] == 3.0 and got[3] is None
    assert got[1:3] == pytest.approx([3 * (1 + z(h, 1.5, 5)) * math.exp(-z(h, 1.5, 5)) for h in (1.0, 7.5)], rel=1e-9)
    both = [r.v for r in df.where("h > 0").select(M.covariogram("2 Cau(4)^1.5^2 + 1 Gau(3)", "h").alias("v")).collect()]
    assert both == pytest.approx([2 * (1 + (h / 4) ** 1.5) ** (-2 / 1.5) + math.exp(-((h / 3) ** 2)) for h in (1.0, 7.5)])
    for bad in ("2 Exp", "1 Tri(3)", "1 Mat(3)", "x Exp(2)"):
        with pytest.raises(ValueError):
            M.covariogram(bad, "h")


def test_run_length_lines():
    n = binary.RUN_NODATA
    assert binary.unpack_line(bytes([1, 16 + 3, 0x21, 0x32]), 10).tolist() == [n, n, n, 1, 1, 2, 2, 2, n, n]
    assert binary.unpack_line(bytes([1]), 4).tolist() == [n] * 4
    assert binary.unpack_line(bytes([1, 255, 16 + 1, 0x17]), 242).tolist() == [n] * 240 + [7, n]
    assert binary.unpack_line(bytes([1, 16, 0xF1]), 6).tolist() == [1] * 6
    assert binary.unpack_lines(bytes([1, 16, 0x41]) + b"\n", 4, 2).tolist() == [[1] * 4, [n] * 4]


def test_only_rd_has_signs():
    body = np.array([5 | 0x4000, 7, 0x2000, 5 | 0x8000], dtype="<u2").tobytes()
    for product, first in (("RD", -0.5), ("RW", 0.5)):
        head = f"{product}031405100000814BY{0:7d}VS 3SW   2.13.1PR E-01INT  60GP   2x   2MS 0<>".encode()
        _, cell = binary.decode_composite(head + b"\x03" + body)
        assert cell["value"][[0, 1, 3]].tolist() == pytest.approx([first, 0.7, 0.5])
        assert np.isnan(cell["value"][2]) and cell["clutter"].tolist() == [False, False, False, True]


def test_gaps_at_the_ends_of_a_ray_are_zero(spark):
    rows = [(0, b, v) for b, v in enumerate([None, 2.0, None, 4.0, None])] + [(1, b, v) for b, v in enumerate([None, 3.0, None])]
    df = spark.createDataFrame(rows, "ray int, bin int, v double")
    got = df.select("ray", "bin", R.fill_linear(F.col("v"), []).alias("f")).orderBy("ray", "bin").collect()
    assert [r.f for r in got] == [0.0, 2.0, 3.0, 4.0, 0.0, 0.0, 3.0, 0.0]


def test_neighbours_of_clusters_and_missing_points(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 1e-3, (3000, 2)), [[1e4, 1e4]]])
    src = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)] + [(9000, None, 0.0), (9001, float("nan"), 0.0)], "src_id long, x double, y double")
    trg = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e-3, 0.0), (3, 9e3, 1e4), (4, float("nan"), 0.0), (5, None, 0.0)], "trg_id long, x double, y double")
    got = spatial.knn(trg, src, 3).orderBy("trg_id", "rank").collect()
    for t, p in ((1, (0, 0)), (2, (1e-3, 0)), (3, (9e3, 1e4))):
        order = np.argsort(((pts - p) ** 2).sum(1), kind="stable")[:3]
        assert [r.src_id for r in got if r.trg_id == t] == order.tolist()
    assert {r.trg_id for r in got} == {1, 2, 3}


def test_neighbours_in_space(spark):
    rng = np.random.default_rng(4)
    src, trg = rng.random((400, 3)), rng.random((30, 3)) * 1.5
    table = lambda a, key: spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(a)], f"{key} long, x double, y double, z double")
    got = spatial.knn(table(trg, "trg_id"), table(src, "src_id"), 5, dims=("x", "y", "z")).collect()
    for k, p in enumerate(trg):
        want = np.argsort(((src - p) ** 2).sum(1))[:5].tolist()
        assert [r.src_id for r in sorted(got, key=lambda r: r["rank"]) if r.trg_id == k] == want


def test_zones_without_sources_have_nulls(spark):
    edges = spark.createDataFrame([(1, 1, 0.25), (1, 2, 0.75)], "trg long, src long, w double")
    values = spark.createDataFrame([(1, 4.0), (2, 8.0)], "src long, value double")
    got = {r.trg: (r.mean, r["var"]) for r in spatial.zonal_stats(edges, values, spark.createDataFrame([(1,), (2,)], "trg long")).collect()}
    assert got == {1: (7.0, 3.0), 2: (None, None)}


def test_echo_without_moments(spark):
    df = spark.createDataFrame([(0, 0, None, 0.9), (1, 0, None, None)], "ray int, bin int, zdr double, rho double")
    got = {r.ray: r for r in weather_probability(df, []).collect()}
    assert got[0].p == 0.0 and not got[0].missing  # a single gate has no texture, and a low rho2 isn't weather
    assert got[1].p is None and got[1].missing


def test_random_rounding_keeps_the_mean(spark):
    df = spark.range(4000).select(shapes.probabilistic_round(F.lit(2.3), 0, 5).alias("v"), shapes.probabilistic_round(F.lit(-1.25), 1, 6).alias("w"))
    r = df.agg(F.avg("v").alias("v"), F.avg("w").alias("w"), F.collect_set("v").alias("s")).first()
    assert sorted(r.s) == [2.0, 3.0] and r.v == pytest.approx(2.3, abs=0.05) and r.w == pytest.approx(-1.25, abs=0.01)


def test_centroids_and_edges(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [1.0, 2.0, 4.0])], "ring array<struct<x:double,y:double>>, c array<double>")
    r = df.select(shapes.ring_centroid(F.col("ring")).alias("p"), shapes.edges_of(F.col("c")).alias("e"), shapes.even_edges(F.slice("c", 1, 2)).alias("f")).first()
    assert (r.p.x, r.p.y) == (2.0, 1.0) and r.e == [0.5, 1.5, 3.0, 5.0] and r.f == [0.5, 1.5, 2.5]


def test_constant_altitude_map_hides_what_no_beam_sees(spark):
    gates = spark.createDataFrame([(1, 1000.0, 0.0, 150.0, 7.0), (2, 0.0, 1000.0, 150.0, 9.0)], "src_id long, x double, y double, z double, value double")
    points = spark.createDataFrame([(1, 1000.0, 0.0, 150.0), (2, 0.0, 0.0, 2000.0), (3, 9000.0, 0.0, 150.0), (4, 900.0, 900.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: r.value for r in volumes.cappi(gates, points, (0.0, 0.0, 100.0), 5000.0, 0.5, 20.0, 1).collect()}
    assert got == {1: 7.0, 2: None, 3: None, 4: None}
