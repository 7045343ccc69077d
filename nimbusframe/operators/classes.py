"""Hydrometeor classes from tables of trapezoidal membership functions, all in joins and aggregates.

``observations`` is long: keys, obs (name), value and idp, the variable that picks the row of the
table (temperature, say). ``table`` has hmc (class number from 0), obs, lower (the left edge of the idp step) and p1 to p4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusframe.functions.moments import trapezoid, weighted_membership
from nimbusframe.operators.rays import texture

#: Weights and trapezoids of weather echo by decision variable; of zdr, rho and phi the textures count, rho2 is rho itself.
ECHO_WEIGHTS = {"zdr": 0.4, "rho": 0.4, "phi": 0.1, "dop": 0.1, "map": 0.5, "rho2": 0.4, "dr": 0.4, "cpa": 0.4}
ECHO_TRAPEZOIDS = {
    "zdr": (0.7, 1.0, 9999, 9999), "rho": (0.1, 0.15, 9999, 9999), "phi": (15, 20, 10000, 10000), "dop": (-0.2, -0.1, 0.1, 0.2),
    "map": (1, 1, 9999, 9999), "rho2": (-9999, -9999, 0.95, 0.98), "dr": (-20, -12, 9999, 9999), "cpa": (0.6, 0.9, 9999, 9999),
}


def weather_probability(gates: DataFrame, keys: list[str], weights: dict[str, float] | None = None, trapezoids: dict[str, tuple] | None = None, n_rays: int = 360) -> DataFrame:
    """Adds p, the probability of weather echo by fuzzy logic, and missing, whether no polarimetric moment is there.

    ``gates`` has ray, bin and any of zdr, rho, phi, dop, map, dr, cpa; variables that are null don't count, and p is null where none does."""
    weights, trapezoids = ECHO_WEIGHTS | (weights or {}), ECHO_TRAPEZOIDS | (trapezoids or {})
    out = gates
    for name in ("zdr", "rho", "phi"):
        if name in gates.columns:
            out = texture(out, name, keys, n_rays).withColumnRenamed("texture", f"__{name}")
    value = {n: F.col(f"__{n}") if n in ("zdr", "rho", "phi") else F.col("rho" if n == "rho2" else n) for n in weights if n in gates.columns or (n == "rho2" and "rho" in gates.columns)}
    parts = [(1.0 - trapezoid(v, *map(float, trapezoids[n])), weights[n]) for n, v in value.items()]
    moments = [F.col(n).isNull() for n in ("rho", "zdr", "phi", "dr", "cpa") if n in gates.columns]
    missing = F.lit(True)
    for m in moments:
        missing = missing & m
    return out.withColumn("p", weighted_membership(parts)).withColumn("missing", missing).select(*gates.columns, "p", "missing")


def membership(v: Column, p: list[Column]) -> Column:
    """1 from p[1] to p[2], falling to 0 at p[0] and p[3]; a missing value has none."""
    rise, fall = F.try_divide(v - p[0], p[1] - p[0]), F.try_divide(v - p[3], p[2] - p[3])
    return F.when((v >= p[1]) & (v <= p[2]), 1.0).when((v >= p[0]) & (v < p[1]), rise).when((v > p[2]) & (v <= p[3]), fall).otherwise(0.0)


def memberships(observations: DataFrame, table: DataFrame, keys: list[str], first: float, step: float, n_steps: int) -> DataFrame:
    """keys, obs, hmc and m. Outside the table's steps all four parameters are zero."""
    at = F.floor((F.col("idp") - first) / step)
    o = observations.withColumn("__k", F.when((at >= 0) & (at < n_steps), at).otherwise(F.lit(-1).cast("long")))
    rows = table.select("hmc", "obs", F.floor((F.col("lower") - first) / step + 0.5).alias("__k"), "p1", "p2", "p3", "p4")
    none = table.select("hmc", "obs").distinct().select("hmc", "obs", F.lit(-1).cast("long").alias("__k"), *[F.lit(0.0).alias(f"p{i}") for i in range(1, 5)])
    j = o.join(rows.unionByName(none), ["obs", "__k"])
    return j.select(*keys, "obs", "hmc", membership(F.col("value"), [F.col(f"p{i}") for i in range(1, 5)]).alias("m"))


def class_probability(members: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hmc and p, the mean by the observables' weights (obs, weight)."""
    j = members.join(weights, "obs")
    return j.groupBy(*keys, "hmc").agg(F.try_divide(F.sum(F.col("m") * F.col("weight")), F.sum("weight")).alias("p"))


def classified(probabilities: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """keys and ``ranking``: structs (p, hmc) from the least to the most likely, with the dry class (numbered after the last) at 0.

    Where the classes' mean is at or below the threshold every entry is the dry class with 1.
    """
    g = probabilities.groupBy(*keys).agg(F.collect_list(F.struct("p", F.col("hmc").cast("int").alias("hmc"))).alias("c"), F.avg("p").alias("__mean"))
    ranked = F.array_sort(F.concat("c", F.array(F.struct(F.lit(0.0).alias("p"), F.size("c").alias("hmc")))))
    dry = F.transform(ranked, lambda s: F.struct(F.lit(1.0).alias("p"), F.size("c").alias("hmc")))
    return g.select(*keys, F.when(F.col("__mean") <= threshold, dry).otherwise(ranked).alias("ranking"))
