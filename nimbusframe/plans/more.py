"""Further queries by name, and the same in SQL: volumes, grids, rings, smoothing and echo classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusframe.functions import geodesic as E
from nimbusframe.functions import georef as G
from nimbusframe.functions import moments as M
from nimbusframe.functions import shapes as H
from nimbusframe.operators import classes as C
from nimbusframe.operators import grids as D
from nimbusframe.operators import volumes as V
from nimbusframe.plans.views import SQL, dualpol, gauges, grid, sweep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def r6(v: Column, name: str) -> Column:
    return (F.round(v, 6) + F.lit(0.0)).alias(name)


def q6(expression: str, name: str) -> str:
    return f"round({expression}, 6)+0.0::DOUBLE AS {name}"


# volumes on a grid
SITE = (0.0, 0.0, 100.0)
GRID = ((137.0, 59.0), 8000.0, 3000.0, 2000.0, 1000.0)


def _volume(s: SparkSession, d: str) -> DataFrame:
    v = sweep(s, d)
    x, y, z = G.spherical_to_xyz((F.col("bin") + 1) * 250.0, F.col("ray") + 0.5, (F.col("ray") % 10 + 0.5).cast("double"), SITE[2])
    return v.select((F.col("ray") * 1_000_000 + F.col("bin")).alias("src_id"), x.alias("x"), y.alias("y"), z.alias("z"), F.col("dbz").alias("value"))


RE = "(4.0::DOUBLE/3*6371000)"
HEIGHT = lambda r, el: f"(sqrt({r}*{r}+({RE}+100)*({RE}+100)+2*{r}*({RE}+100)*sin(radians({el})))-{RE})"
VOLUME = f"""{SQL['sw']}, v0 AS (SELECT ray*1000000+bin AS src_id, (bin+1)*250.0::DOUBLE AS r, ray+0.5::DOUBLE AS az, ray%10+0.5::DOUBLE AS el, dbz FROM sw),
v1 AS (SELECT *, {HEIGHT('r', 'el')} AS z FROM v0), v AS (SELECT src_id, {RE}*asin(r*cos(radians(el))/({RE}+z))*cos(radians(90-az)) AS x, {RE}*asin(r*cos(radians(el))/({RE}+z))*sin(radians(90-az)) AS y, z, dbz FROM v1)"""
POINTS = "g3 AS (SELECT l*81+r*9+c AS id, 137-8000.0::DOUBLE+c*2000 AS x, 59-8000.0::DOUBLE+r*2000 AS y, l*1000.0::DOUBLE AS z FROM (SELECT unnest(range(4)) AS l), (SELECT unnest(range(9)) AS r), (SELECT unnest(range(9)) AS c))"
VIEW = f"g4 AS (SELECT *, sqrt(x*x+y*y+(z-100)*(z-100)) AS d FROM g3), b AS (SELECT *, z < {HEIGHT('d', '0.5')} AS below, z > {HEIGHT('d', '9.5')} AS above, d > 7000 AS far FROM g4)"


def _ip(hidden: str) -> str:
    return f"""WITH {VOLUME}, {POINTS}, {VIEW}, n AS (SELECT b.id, dbz, (b.x-v.x)*(b.x-v.x)+(b.y-v.y)*(b.y-v.y)+(b.z-v.z)*(b.z-v.z) AS d2, row_number() OVER (PARTITION BY b.id ORDER BY (b.x-v.x)*(b.x-v.x)+(b.y-v.y)*(b.y-v.y)+(b.z-v.z)*(b.z-v.z), src_id) AS k FROM b, v WHERE NOT ({hidden})),
    i AS (SELECT id, sum(dbz/d2)/sum(1/d2) AS value FROM n WHERE k <= 4 GROUP BY id) SELECT b.id, round(value, 5)+0.0::DOUBLE AS value FROM b LEFT JOIN i USING (id)"""


_grid = lambda s: D.grid_3d(s, *GRID)
_out = lambda df: df.select("id", (F.round("value", 5) + F.lit(0.0)).alias("value"))
register("cappi", lambda s, d: _out(V.cappi(_volume(s, d), _grid(s), SITE, 7000.0, 0.5, 9.5)), _ip("below OR above OR far"))
register("pseudo_cappi", lambda s, d: _out(V.cappi(_volume(s, d), _grid(s), SITE, 7000.0)), _ip("far"))
register("grid_3d", lambda s, d: _grid(s), f"WITH {POINTS} SELECT * FROM g3")
register("blindspots", lambda s, d: _grid(s).select("id", *[v.alias(n) for v, n in zip(V.blind(SITE, 0.5, 9.5, 7000.0), ("below", "above", "far"), strict=True)]), f"WITH {POINTS}, {VIEW} SELECT id, below, above, far FROM b")
register(
    "georeference",
    lambda s, d: D.georeference(sweep(s, d).select("ray", "bin", ((F.col("bin") + 1) * 250.0).alias("range"), (F.col("ray") + 0.5).alias("azimuth"), (F.col("ray") % 10 + 0.5).cast("double").alias("elevation")), SITE[2]).select("ray", "bin", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("z"), "z"), r6(F.col("gr"), "gr")),
    f"WITH {VOLUME} SELECT src_id // 1000000 AS ray, src_id % 1000000 AS bin, {q6('x', 'x')}, {q6('y', 'y')}, {q6('z', 'z')}, {q6('sqrt(x*x+y*y)', 'gr')} FROM v",
)
register("sweep_centroids", lambda s, d: D.sweep_centroids(s, 360, 100, 250.0, 0.5), "SELECT r AS ray, b AS bin, (b+0.5::DOUBLE)*250 AS range, r+0.5::DOUBLE AS azimuth, 0.5::DOUBLE AS elevation FROM (SELECT unnest(range(360)) AS r), (SELECT unnest(range(100)) AS b)")
EL = "CASE s WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5 ELSE 4.5 END"
register(
    "volume_coordinates",
    lambda s, d: D.volume_coordinates(s, [0.5, 1.5, 4.5], 36, 40, 1000.0, 100.0).select("elevation", "ray", "bin", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("z"), "z")),
    f"WITH a AS (SELECT {EL} AS elevation, r AS ray, b AS bin, (b+0.5::DOUBLE)*1000 AS r, (r+0.5::DOUBLE)*10 AS az FROM (SELECT unnest(range(3)) AS s), (SELECT unnest(range(36)) AS r), (SELECT unnest(range(40)) AS b)), h AS (SELECT *, {HEIGHT('r', 'elevation')} AS z FROM a), p AS (SELECT *, {RE}*asin(r*cos(radians(elevation))/({RE}+z)) AS g FROM h) SELECT elevation, ray, bin, {q6('g*cos(radians(90-az))', 'x')}, {q6('g*sin(radians(90-az))', 'y')}, {q6('z', 'z')} FROM p",
)

# smoothing and moving along rays
MED = "list_sort([coalesce(lag(dbz, 2) OVER w, 0), coalesce(lag(dbz) OVER w, 0), dbz, coalesce(lead(dbz) OVER w, 0), coalesce(lead(dbz, 2) OVER w, 0)])[3]"
register("median_smoothed", lambda s, d: D.median_smoothed(sweep(s, d), "dbz", []).select("ray", "bin", r6(F.col("smooth"), "smooth")), f"WITH {SQL['sw']} SELECT ray, bin, {q6(MED, 'smooth')} FROM sw WINDOW w AS (PARTITION BY ray ORDER BY bin)")
register("smoothed_gradient", lambda s, d: D.smoothed_gradient(sweep(s, d), "dbz", []).select("ray", "bin", r6(F.col("slope"), "slope")), f"WITH {SQL['sw']}, m AS (SELECT ray, bin, {MED} AS v FROM sw WINDOW w AS (PARTITION BY ray ORDER BY bin)) SELECT ray, bin, {q6('CASE WHEN row_number() OVER w = 1 THEN lead(v) OVER w - v WHEN lead(1) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w)/2 END', 'slope')} FROM m WINDOW w AS (PARTITION BY ray ORDER BY bin)")
register("rolled", lambda s, d: D.rolled(sweep(s, d), 360, 7, 2).select("ray", "bin", r6(F.col("dbz"), "dbz")), f"WITH {SQL['sw']} SELECT a.ray, a.bin, {q6('b.dbz', 'dbz')} FROM sw a LEFT JOIN sw b ON b.ray = (a.ray-7+360) % 360 AND b.bin = a.bin-2")

# echo classification
AROUND = "o AS (SELECT r.k AS dr, c.k AS db FROM (SELECT unnest([-1,0,1]) AS k) r, (SELECT unnest([-1,0,1]) AS k) c WHERE r.k <> 0 OR c.k <> 0)"
TRZ = lambda v, a, b, c, d: f"(1-CASE WHEN {v} BETWEEN {b} AND {c} THEN 1 WHEN {v} > {a} AND {v} < {b} THEN ({v}-({a}))/nullif({b}-({a}), 0) WHEN {v} > {c} AND {v} < {d} THEN ({d}-{v})/nullif({d}-({c}), 0) ELSE 0 END)"
ECHO = {"tz": (0.7, 1.0, 9999, 9999, 0.4), "tr": (0.1, 0.15, 9999, 9999, 0.4), "tp": (15, 20, 10000, 10000, 0.1), "dop": (-0.2, -0.1, 0.1, 0.2, 0.1), "map": (1, 1, 9999, 9999, 0.5), "rho": (-9999, -9999, 0.95, 0.98, 0.4)}
register(
    "fuzzy_echo",
    lambda s, d: C.weather_probability(dualpol(s, d).withColumn("dop", F.col("dbz") % 1 - 0.5).withColumn("map", (F.col("ray") % 2).cast("double")), []).select("ray", "bin", r6(F.col("p"), "p"), "missing"),
    f"""WITH {SQL['dp']}, {AROUND}, m AS (SELECT a.ray, a.bin, any_value(a.dbz) AS dbz, any_value(a.rho) AS rho, sqrt(avg((b.zdr-a.zdr)*(b.zdr-a.zdr))) AS tz, sqrt(avg((b.rho-a.rho)*(b.rho-a.rho))) AS tr, sqrt(avg((b.phi-a.phi)*(b.phi-a.phi))) AS tp FROM dp a, o LEFT JOIN dp b ON b.ray = (a.ray+dr+360) % 360 AND b.bin = a.bin+db GROUP BY a.ray, a.bin),
    e AS (SELECT *, dbz % 1 - 0.5 AS dop, (ray % 2)::DOUBLE AS map FROM m) SELECT ray, bin, {q6('(' + '+'.join(f"{w}*coalesce({TRZ(v, *t)}, 0)" for v, (*t, w) in ECHO.items()) + ')/(' + '+'.join(f'CASE WHEN {v} IS NULL THEN 0 ELSE {w} END' for v, (*_, w) in ECHO.items()) + ')', 'p')}, false AS missing FROM e""",
)
register(
    "covariogram_strings",
    lambda s, d: sweep(s, d).select("ray", "bin", r6(M.covariogram("0.5 Nug(1) + 2 Exp(20) + 1.5 Sph(30)", "dbz"), "nested"), r6(M.covariogram("2 Mat(20)^0.5", "dbz"), "mat")),
    f"WITH {SQL['sw']} SELECT ray, bin, {q6('CASE WHEN dbz <= 1 THEN 0.5 ELSE 0 END + 2*exp(-dbz/20) + CASE WHEN dbz < 30 THEN 1.5*(1-1.5*dbz/30+pow(dbz/30, 3)/2) ELSE 0 END', 'nested')}, {q6('2*exp(-dbz/20*sqrt(2))', 'mat')} FROM sw",
)

# grids, rings and rasters
FAC = "(6370.040::DOUBLE*6370.040*pow(1+sin(radians(60)), 2))"
X0 = "(6370.040::DOUBLE*(1+sin(radians(60)))/(1+sin(radians(51)))*cos(radians(51)))"
register(
    "composite_grid",
    lambda s, d: D.composite_grid(s, 200, 200).select("row", "col", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("lon"), "lon"), r6(F.col("lat"), "lat")),
    f"WITH p AS (SELECT r AS row, c AS col, {X0}*sin(radians(-1))-200+c*2 AS x, -{X0}*cos(radians(-1))-200+r*2 AS y FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(200)) AS c)) SELECT row, col, {q6('x', 'x')}, {q6('y', 'y')}, {q6('degrees(atan(-x/y))+10', 'lon')}, {q6(f'degrees(asin(({FAC}-x*x-y*y)/({FAC}+x*x+y*y)))', 'lat')} FROM p",
)
_corners = lambda s, d: grid(s, d).select(F.col("y").alias("row"), F.col("x").alias("col"), (F.col("x") * 2.0 + F.col("y") * 0.5).alias("x"), (F.col("y") * 3.0).alias("y"))
register(
    "cell_rings",
    lambda s, d: D.cell_rings(_corners(s, d)).select("row", "col", r6(G.ring_area(F.col("ring")), "area"), r6(F.col("ring")[2]["x"], "x2"), r6(H.ring_centroid(F.col("ring"))["x"], "cx"), r6(H.ring_centroid(F.col("ring"))["y"], "cy")),
    f"WITH {SQL['r']} SELECT a.y AS row, a.x AS col, 6.0::DOUBLE AS area, {q6('(a.x+1)*2.0+(a.y+1)*0.5', 'x2')}, {q6('(a.x*2+a.y*0.5)+1.25', 'cx')}, {q6('a.y*3+1.5', 'cy')} FROM r a JOIN r b ON b.x = a.x+1 AND b.y = a.y JOIN r c ON c.x = a.x+1 AND c.y = a.y+1 JOIN r e ON e.x = a.x AND e.y = a.y+1",
)
register(
    "cell_boxes",
    lambda s, d: grid(s, d).select("pt", r6(G.ring_area(H.box_around("x", "y", 2, 3)), "area"), r6(H.box_around("x", "y", 2, 3)[2]["y"], "top"), r6(H.ring_around("x", "y", 0.5, 0.25)[1]["x"], "left"), r6(H.grid_index("x", -1.0, 0.5), "index"), r6(H.pixel_to_map("x", "y", (5.0, 2.0, 0.1, 50.0, 0.2, -3.0))[0], "mx"), r6(H.pixel_to_map("x", "y", (5.0, 2.0, 0.1, 50.0, 0.2, -3.0))[1], "my")),
    f"WITH {SQL['r']} SELECT pt, 6.0::DOUBLE AS area, {q6('y+1.5', 'top')}, {q6('x-0.5', 'left')}, {q6('(x+1)/0.5', 'index')}, {q6('5+2*x+0.1*y', 'mx')}, {q6('50+0.2*x-3*y', 'my')} FROM r",
)
register(
    "gate_rings",
    lambda s, d: sweep(s, d).select("ray", "bin", r6(G.ring_area(G.gate_polygon((F.col("bin") + 1) * 250.0, F.col("ray") + 0.5, 250.0, 1.0)), "area")),
    f"WITH {SQL['sw']} SELECT ray, bin, {q6('((bin+1.5::DOUBLE)*(bin+1.5)-(bin+0.5::DOUBLE)*(bin+0.5))*250*250*sin(radians(1))/2', 'area')} FROM sw",
)
register(
    "axis_edges",
    lambda s, d: gauges(s, d).groupBy("y").agg(F.sort_array(F.collect_set(F.col("x").cast("double"))).alias("xs")).where("size(xs) > 1").select("y", F.posexplode(H.edges_of(F.col("xs"))).alias("n", "edge"), H.even_edges(F.col("xs"))[1].alias("second")),
    f"WITH {SQL['g']}, a AS (SELECT y, list_sort(list_distinct(list(x::DOUBLE))) AS xs FROM g GROUP BY y HAVING count(DISTINCT x) > 1), i AS (SELECT y, xs, unnest(range(len(xs)+1)) AS k FROM a) SELECT y, k::INT AS n, CASE WHEN k = 0 THEN xs[1]-(xs[2]-xs[1])/2 WHEN k = len(xs) THEN xs[k]+(xs[k]-xs[k-1])/2 ELSE (xs[k]+xs[k+1])/2 END AS edge, xs[1]+(xs[2]-xs[1])/2 AS second FROM i",
)
register("extents", lambda s, d: D.extent(gauges(s, d).withColumn("part", F.col("k") % 7), ["part"]).withColumn("aspect", F.round("aspect", 6)), f"WITH {SQL['g']} SELECT k % 7 AS part, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, round((max(x)-min(x))/nullif(max(y)-min(y), 0), 6) AS aspect FROM g GROUP BY 1")
_cells = lambda s, d: table(s, d, "events").groupBy(F.expr("event_id div 40 % 50").alias("row"), (F.col("event_id") % 40).alias("col"), (F.col("user_id") % 4).alias("source")).agg(F.max(F.when(F.col("event_type") != "click", F.col("value"))).alias("value"))
CELLS = "c AS (SELECT event_id // 40 % 50 AS row, event_id % 40 AS col, user_id % 4 AS source, max(CASE WHEN event_type <> 'click' THEN value END) AS value FROM events GROUP BY 1, 2, 3)"
register("merged_rasters", lambda s, d: D.merged_rasters(_cells(s, d)), f"WITH {CELLS} SELECT row, col, arg_max(value, CASE WHEN value IS NOT NULL THEN source END) AS value FROM c GROUP BY 1, 2")
register("flipped_raster", lambda s, d: D.flipped(D.merged_rasters(_cells(s, d)), 50), f"WITH {CELLS} SELECT 49-row AS row, col, arg_max(value, CASE WHEN value IS NOT NULL THEN source END) AS value FROM c GROUP BY 1, 2")


def _chain(s: SparkSession, d: str) -> DataFrame:
    v = sweep(s, d).withColumn("gate", F.struct("ray", "bin"))  # the id of the result isn't one gate's where rays are long
    each = [v.select("gate", F.when(F.col("dbz") > low, F.col("dbz") + add).alias("v")) for low, add in ((40, 0.0), (20, 100.0), (10, 200.0))]
    return D.chained(each, "gate", "v").select((F.col("gate.ray") * 1000 + F.col("gate.bin")).alias("id"), r6(F.col("v"), "v"))


register("interpolation_chain", _chain, f"WITH {SQL['sw']} SELECT ray*1000+bin AS id, {q6('CASE WHEN dbz > 40 THEN dbz WHEN dbz > 20 THEN dbz+100 WHEN dbz > 10 THEN dbz+200 END', 'v')} FROM sw")
register(
    "product_times",
    lambda s, d: table(s, d, "orders").select("o_orderkey", H.product_time(F.concat(F.lit("raa00-dx_"), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"), F.lit("-"), F.date_format("o_orderdate", "yyMMddHHmm"), F.lit("-fbg---bin.gz"))).alias("time"), H.rain_type(F.col("o_orderkey") % 4 * 10_000_000 + 5).alias("rain_type")),
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN date_trunc('minute', o_orderdate) ELSE date_trunc('minute', o_orderdate) + INTERVAL 100 YEAR END AS time, CASE o_orderkey % 4 WHEN 3 THEN 1 ELSE o_orderkey % 4 END::INT AS rain_type FROM orders",
)

# on the ellipsoid: no SQL, tests compare with known lines
register("gate_lonlat", lambda s, d: sweep(s, d).withColumn("p", E.gate_lonlat((F.col("bin") + 1) * 250.0, F.col("ray") + 0.5, F.lit(0.5), (9.0, 51.0, 100.0))).select("ray", "bin", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat")))
register("ground_distance", lambda s, d: gauges(s, d).select("k", F.round(E.ground_distance(F.col("x") / 5 + 5, F.col("y") / 40 + 47, F.lit(9.0), F.lit(51.0)), 3).alias("distance")))
