"""Known values, file formats and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbusframe.functions import georef, moments
from nimbusframe.operators import rays, spatial
from nimbusframe.sources import binary
from nimbusframe.streaming.accumulate import accumulate


def values(df, column="v"):
    return [r[column] for r in df.collect()]


def test_attenuation_of_a_ramp(spark):
    df = spark.createDataFrame([([0.0, 3.0, 6.0, 9.0, 12.0],)], "z array<double>")
    got = df.select(rays.attenuation_forward(F.col("z"), 2e-4, 0.7, 1.0)).first()[0]
    want = [0.0]
    for z in [0.0, 3.0, 6.0, 9.0]:
        want.append(want[-1] + 2e-4 * (10 ** ((z + want[-1]) / 10)) ** 0.7 * 2)
    assert got == pytest.approx(want)


def test_undefined_values_are_null(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (10.0,)], "v double")
    assert values(df.select(moments.decibel("v").alias("v"))) == [None, None, 10.0]
    assert values(df.select(moments.valid("v", 0.0).alias("v"))) == [0.0, None, 10.0]


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(0)
    src = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(500, 3, (50, 2)), [[1e4, -1e4]]])
    trg = np.concatenate([rng.uniform(-50, 600, (40, 2)), [[-3e4, 3e4]], src[:3]])
    f = lambda a, i: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], f"{i} long, x double, y double")
    got = sorted((r.trg_id, r.rank, r.src_id) for r in spatial.knn(f(trg, "trg_id"), f(src, "src_id"), 5).collect())
    want = []
    for t, p in enumerate(trg):
        d = ((p - src) ** 2).sum(1)
        want += [(t, k + 1, int(i)) for k, i in enumerate(np.lexsort((np.arange(len(src)), d))[:5])]
    assert got == want
    few = spatial.knn(f(trg[:3], "trg_id"), f(src[:2], "src_id"), 5)
    assert few.count() == 6
    assert spatial.knn(f(trg[:3], "trg_id"), f(src[:0].reshape(0, 2), "src_id"), 5).count() == 0


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    df = spark.createDataFrame([(ring, 1.0, 1.0), (ring, 5.0, 1.0), (ring, 1.0, 3.5)], "ring array<struct<x:double,y:double>>, x double, y double")
    assert values(df.select(georef.point_in_ring("x", "y", F.col("ring")).alias("v"))) == [True, False, False]
    assert values(df.select(georef.ring_area(F.col("ring")).alias("v"))) == [12.0] * 3


def test_correlation_p_value():
    assert spatial.t_tail(0.5, 12) == pytest.approx(0.0979, abs=2e-4)
    assert spatial.t_tail(0.9, 10) == pytest.approx(0.000390, rel=0.02)


def composite(product, rows, cols, body, extra=""):
    head = f"{product}030950100000814BY{{:7d}}VS 3SW   2.13.1PR E-01INT  60GP{rows:4d}x{cols:4d}{extra}MS 17<boo,ros,emd>"
    return head.format(len(head.format(0)) + 1 + len(body)).encode() + b"\x03" + body


def test_composite(spark, tmp_path):
    words = np.array([10, 0x2000 | 2500, 0x8000 | 7, 0x1000 | 3, 0x4000 | 5, 0], dtype="<u2")
    (tmp_path / "rw").write_bytes(composite("RW", 2, 3, words.tobytes()))
    rows = binary.read_composites(spark, str(tmp_path / "rw")).orderBy("row", "col").collect()
    assert rows[1].value is None
    assert [r.value for r in rows if r.value is not None] == pytest.approx([1.0, 0.7, 0.3, 0.5, 0.0])
    assert [r.clutter for r in rows] == [False, False, True, False, False, False]
    assert [r.secondary for r in rows] == [False, False, False, True, False, False]
    head = binary.decode_composite((tmp_path / "rw").read_bytes())[0]
    assert (head["rows"], head["cols"], head["precision"], head["interval_seconds"], head["radars"]) == (2, 3, 0.1, 3600, ["boo", "ros", "emd"])
    assert str(head["time"]) == "2014-08-03 09:50:00"
    with pytest.raises(OSError):
        binary.decode_composite(composite("RW", 2, 3, words[:4].tobytes()))


def test_tilt(spark, tmp_path):
    import gzip

    words = []
    for az in (5, 15):
        words += [0x2000, az, 8, 100, 0x1000 | 3, 0x8000 | 65]
    body = np.array(words, dtype="<u2").tobytes()
    head = "DX021655109080608BY{:5d}VS 2CO0CD4CS0EP0.30.30.40.50.50.40.40.4MS  0"
    (tmp_path / "dx.gz").write_bytes(gzip.compress((head.format(len(head.format(0)) + 1 + len(body))).encode() + b"\x03" + body))
    rows = binary.read_tilts(spark, str(tmp_path / "dx.gz")).orderBy("ray", "bin").collect()
    assert [r.dbz for r in rows[:5]] == [17.5, -32.5, -32.5, -32.5, 0.0]
    assert [r.clutter for r in rows[:5]] == [False] * 4 + [True]
    assert {(r.ray, r.azimuth, r.elevation) for r in rows} == {(0, 0.5, 0.8), (1, 1.5, 0.8)}


def test_ascii_grid_and_polygon_text(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2\n-9999 4\n")
    rows = binary.read_ascii_grid(spark, str(tmp_path / "g.asc")).orderBy("row", "col").collect()
    assert [(r.x, r.y, r.value) for r in rows] == [(11, 23, 1), (13, 23, 2), (11, 21, None), (13, 21, 4)]
    p = spark.createDataFrame([(0, [(0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 1.0)])], "id long, ring array<struct<x:double,y:double,z:double,m:double>>")
    binary.write_polygon_text(p, str(tmp_path / "p"))
    assert values(spark.read.text(str(tmp_path / "p")), "value") == ["Polygon", "0 0", "0 0.000000 0.000000 0.000000 0.000000", "1 0.000000 1.000000 0.000000 1.000000", "END"]


def test_accumulation_of_a_stream_equals_the_table(spark, tmp_path):
    df = spark.createDataFrame([("a", f"2020-01-01 00:{m:02d}:00", 20.0 + m) for m in range(0, 60, 2)], "site string, t string, dbz double").select("site", F.to_timestamp("t").alias("t"), "dbz")
    df.write.parquet(str(tmp_path / "in"))
    q = accumulate(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "dbz", "site").writeStream.format("memory").queryName("acc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spark.table("acc")) == rows(accumulate(df, "t", "dbz", "site"))


def test_histogram_cut(spark):
    v = [float(x) for x in np.random.default_rng(0).normal(500, 20, 3000)] + [5000.0, 5001.0, -4000.0]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    got = [(r.v, r.mask) for r in rays.histogram_cut(df, "v").collect()]
    assert {m for x, m in got if x == 5000.0 or x == 5001.0} == {1}
    assert {m for x, m in got if x == -4000.0} == {2}
    assert {m for x, m in got if x is not None and 470 < x < 530} == {0}
    assert {m for x, m in got if x is None} == {None}
