"""What shows only on larger tables: joins that Spark takes for small, blocks, long rays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbusframe.functions import georef
from nimbusframe.operators import neighbours, spatial, sweeps
from nimbusframe.operators import rays as R
from nimbusframe.plans import catalogue, more


def points(spark, a, key):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(a)], f"{key} long, " + ", ".join(f"{c} double" for c in "xyz"[: len(a[0])]))


@pytest.mark.parametrize("space", [2, 3])
def test_neighbours_across_blocks(spark, monkeypatch, space):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "PIECE", 30)
    rng = np.random.default_rng(3)
    src = np.concatenate([rng.integers(0, 12, (300, space)), np.full((250, space), 5.0), rng.normal(400, 1, (60, space))])
    trg = np.concatenate([rng.integers(-3, 15, (80, space)), np.full((70, space), 5.0), rng.uniform(-900, 900, (50, space))])
    dims = tuple("xyz"[:space])
    got = {}
    for r in spatial.knn(points(spark, trg, "trg_id"), points(spark, src, "src_id"), 4, dims=dims).collect():
        got.setdefault(r.trg_id, {})[r.rank] = (r.src_id, r.d2)
    for t, p in enumerate(trg):
        d = ((p - src) ** 2).sum(1)
        order = np.lexsort((np.arange(len(src)), d))[:4]
        assert [got[t][k + 1][0] for k in range(4)] == order.tolist()
        assert [got[t][k + 1][1] for k in range(4)] == pytest.approx(d[order])


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_broadcast_nothing(spark, tmp_path):
    """The tables are small, and so Spark would send one side to all tasks; at a gigabyte the driver can't hold it."""
    spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 40).alias("x"), F.expr("id div 40").alias("y"), (F.col("id") % 9 + 1.0).alias("obs")).write.parquet(f"{tmp_path}/g")
    spark.range(700).select(F.col("id").alias("pt"), (F.col("id") % 50).alias("x"), F.expr("id div 50").alias("y"), (F.col("id") % 7 + 1.0).alias("raw")).write.parquet(f"{tmp_path}/r")
    g, r = spark.read.parquet(f"{tmp_path}/g"), spark.read.parquet(f"{tmp_path}/r")
    near = spatial.knn(r.select(F.col("pt").alias("trg_id"), "x", "y"), g.select(F.col("k").alias("src_id"), "x", "y"), 4)
    vals = g.select(F.col("k").alias("src_id"), "x", "y", "obs", F.col("y").alias("drift"))
    for df in (
        near, spatial.idw(near, vals, ["obs"]), spatial.nearest(near, vals, ["obs"]), spatial.raw_at_gauges(g, r), spatial.raw_at_gauges(g, r, 9, "best"), spatial.cross_validate(g, r), spatial.adjust_mfb(g, r),
        spatial.ordinary_kriging(near, vals, "obs"), spatial.ordinary_kriging(near, vals, "obs", drift=r.select(F.col("pt").alias("trg_id"), F.col("y").alias("drift"))), *[spatial.adjust(k, g, r) for k in ("add", "multiply", "mixed", "gage_only", "none")],
    ):
        assert "Broadcast" not in joins(df)


def test_gates_of_long_rays_have_numbers_of_their_own(spark, tmp_path):
    keys = [5 * 360 + 1, 100005 * 360, 7 * 360 + 2]  # ray 1, bin 5 and ray 0, bin 100005
    spark.createDataFrame([(k, float(k % 50)) for k in keys], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, 10.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.QUERIES["polar_neighbours"](spark, str(tmp_path)).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]


def test_filling_reads_a_ray_in_linear_time(spark):
    plan = joins(spark.range(10).select(F.lit(0).alias("ray"), F.col("id").alias("bin"), F.when(F.col("id") % 3 == 0, 1.0).alias("v")).select(R.fill_linear(F.col("v"), [])))
    assert "unboundedfollowing" not in plan.replace(" ", "").lower()


def test_longitude_and_latitude_past_the_poles(spark, tmp_path):
    """The south pole is infinitely far; angles past a pole come back as they were given."""
    y = [0, 430, 431, 700, 2229, 2230, 2231, 3000, 4030, 9999]
    spark.createDataFrame([(40 * r + c, 1.0) for r in y for c in (0, 25, 39)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.k: r for r in catalogue.QUERIES["radolan_xy"](spark, str(tmp_path)).collect()}
    for k, r in got.items():
        assert (r.lon, r.lat) == (pytest.approx(k % 40 / 5 + 5, abs=1e-6), pytest.approx(k // 40 / 10 + 47, abs=1e-6))
    assert got[2230 * 40].sx == got[2230 * 40].sy == np.inf
    back = spark.range(1).select(*georef.stereographic_to_lonlat(F.lit(np.inf), F.lit(0.0))).first()
    assert tuple(back) == (None, -90.0)


def test_tile_names_have_two_and_three_digits(spark):
    got = spark.createDataFrame([(-20.0, 100.0), (8.5, -7.5), (1234.0, 5.0)], "x double, y double").select(georef.srtm_tile("x", "y")).collect()
    assert [r[0] for r in got] == ["N10W020", "S08E008", "N05E123"]


def test_chain_on_long_rays(spark, tmp_path):
    """Gate 1005 of ray 0 and gate 5 of ray 1 have one id in the result, but are two gates."""
    spark.createDataFrame([(1005 * 360, 45.0), (5 * 360 + 1, 15.0)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, more.QUERIES["interpolation_chain"](spark, str(tmp_path)).collect())) == [(1005, 45.0), (1005, 215.0)]


def test_similar_neighbours_form_no_exploded_join(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(0, 20, (12, 30)).astype(float)
    gone = rng.random(v.shape) < 0.2
    null = rng.random(v.shape) < 0.1
    df = spark.createDataFrame([(i, j, None if null[i, j] else float(v[i, j])) for i, j in np.ndindex(v.shape) if not gone[i, j]], "ray int, bin int, v double")
    out = R.similar_neighbours(df, "v", [], 12, 30, 5, 6.0)
    assert "Broadcast" not in joins(out)
    v[gone | null] = np.nan
    for r in out.collect():
        with np.errstate(invalid="ignore"):
            around = [v[(r.ray + a) % 12, (r.bin + b) % 30] for a in range(-2, 3) for b in range(-2, 3)]
            want = 25 if r.bin < 2 or r.bin >= 28 else sum(v[r.ray, r.bin] - x < 6 for x in around) - 1
        assert r.similar == want


def test_attenuation_of_long_rays_takes_linear_time(spark):
    import time

    def run(n):
        df = spark.range(2).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i % 7).cast("double")).alias("z")).select(F.element_at(R.attenuation_forward(F.col("z"), 1e-9), -1).alias("p"))
        t = time.monotonic()
        return df.collect()[0].p, time.monotonic() - t

    run(100)
    z = np.arange(1, 60_001) % 7
    p = 0.0
    for x in z[:-1]:
        p += 1e-9 * (10 ** ((x + p) / 10)) ** 0.7 * 2
    got, took = run(60_000)
    assert got == pytest.approx(p, rel=1e-9)
    assert took < 20
    assert [r.p for r in spark.sql("SELECT array(1D) AS v UNION ALL SELECT cast(array() as array<double>) UNION ALL SELECT NULL").select(R.attenuation_forward(F.col("v")).alias("p")).collect()] == [[0.0], [0.0], None]


def test_rain_cells_across_strips(spark, monkeypatch):
    """A sweep cut into strips has the cells of the whole; bins and rays without any gate are as if they weren't there."""
    rng = np.random.default_rng(11)
    v = rng.random((14, 60))
    gone = rng.random(v.shape) < 0.05
    gone[:, [6, 7, 8, 9, 21]] = gone[4] = True
    df = spark.createDataFrame([(k, i, j, float(v[i, j] + k / 10)) for k in (0, 1) for i, j in np.ndindex(v.shape) if not gone[i, j]], "sweep int, ray int, bin int, v double")
    got = []
    for width in (4096, 3):
        monkeypatch.setattr(sweeps, "STRIP", width)
        got.append({(r.sweep, r.ray, r.bin): r.ratio for r in sweeps.rain_cells(df, "v", ["sweep"], 0.6).collect()})
    assert got[0] == got[1]
    assert len(got[0]) == 2 * (~gone).sum()
