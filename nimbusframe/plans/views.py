"""The driver's tables read as radar data, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sweep(spark: SparkSession, sf_dir: str, top: float = 60.0) -> DataFrame:
    """Gates of one sweep of 360 rays."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 360).alias("ray"), F.expr("o_orderkey div 360").alias("bin"), (F.col("o_totalprice") % top).alias("dbz"))


def gap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") % 60)
    return o.select((F.col("o_orderkey") % 360).alias("ray"), F.expr("o_orderkey div 360").alias("bin"), v.alias("dbz"))


def dualpol(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") % 360).alias("ray"), F.expr("o_orderkey div 360").alias("bin"), (F.col("o_totalprice") % 60).alias("dbz"),
        ((F.col("o_custkey") % 50) / 10 - 1).alias("zdr"), (0.7 + (F.col("o_orderkey") % 30) / 100).alias("rho"), (F.col("o_totalprice") % 360 - 180).alias("phi"),
    )


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 40).alias("x"), F.expr("c_custkey div 40").alias("y"), (F.abs("c_acctbal") / 100).alias("obs"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pt"), (F.col("p_partkey") % 50).alias("x"), F.expr("p_partkey div 50").alias("y"), F.col("p_size").cast("double").alias("raw"))


#: The same views as common table expressions.
SQL = {
    "sw": "sw AS (SELECT o_orderkey % 360 AS ray, o_orderkey // 360 AS bin, o_totalprice % 60 AS dbz FROM orders)",
    "att": "sw AS (SELECT o_orderkey % 360 AS ray, o_orderkey // 360 AS bin, o_totalprice % 40 AS dbz FROM orders)",
    "gap": "sw AS (SELECT o_orderkey % 360 AS ray, o_orderkey // 360 AS bin, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice % 60 END AS dbz FROM orders)",
    "dp": "dp AS (SELECT o_orderkey % 360 AS ray, o_orderkey // 360 AS bin, o_totalprice % 60 AS dbz, (o_custkey % 50) / 10 - 1 AS zdr, 0.7::DOUBLE + (o_orderkey % 30) / 100 AS rho, o_totalprice % 360 - 180 AS phi FROM orders)",
    "g": "g AS (SELECT c_custkey AS k, c_custkey % 40 AS x, c_custkey // 40 AS y, abs(c_acctbal) / 100 AS obs FROM customer)",
    "r": "r AS (SELECT p_partkey AS pt, p_partkey % 50 AS x, p_partkey // 50 AS y, p_size::DOUBLE AS raw FROM part)",
}
#: Raw value at the gauges and the pairs that are valid.
SQL["pairs"] = (
    SQL["g"] + ", " + SQL["r"] + """, nn AS (SELECT k, raw, row_number() OVER (PARTITION BY k ORDER BY (g.x-r.x)*(g.x-r.x)+(g.y-r.y)*(g.y-r.y), pt) AS n FROM g, r),
    ra AS (SELECT k, median(raw) AS rawatobs FROM nn WHERE n <= 9 GROUP BY k),
    pairs AS (SELECT g.*, rawatobs FROM g JOIN ra USING (k) WHERE obs NOT IN (-99, 99, -9999) AND rawatobs NOT IN (-99, 99, -9999) AND obs >= 0 AND rawatobs >= 0)"""
)


def interpolated(*fields: str) -> str:
    """CTE ip: inverse-distance means of fields of pairs (the expressions given) on r, from four neighbours."""
    exprs = ", ".join(f"{e} AS f{i}" for i, e in enumerate(fields))
    means = ", ".join(f"CASE WHEN count(f{i}) = count(*) THEN sum(w*f{i})/sum(w) END AS f{i}" for i in range(len(fields)))
    return f"""src AS (SELECT k, x, y, {exprs} FROM pairs),
    kn AS (SELECT r.pt, src.*, (r.x-src.x)*(r.x-src.x)+(r.y-src.y)*(r.y-src.y) AS d2, row_number() OVER (PARTITION BY pt ORDER BY (r.x-src.x)*(r.x-src.x)+(r.y-src.y)*(r.y-src.y), k) AS n FROM r, src),
    kw AS (SELECT *, CASE WHEN d2 = 0 THEN 1e12 ELSE 1.0/d2 END AS w FROM kn WHERE n <= 4),
    ip AS (SELECT pt, {means} FROM kw GROUP BY pt)"""
