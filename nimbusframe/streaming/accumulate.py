"""Rain accumulation over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusframe.functions.moments import idecibel, r_to_depth, z_to_r


def accumulate(df: DataFrame, time: str, dbz: str, site: str, window: str = "5 minutes", seconds: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """Depth by site and tumbling window; on a stream, rows later than ``late`` are left out and windows close after that."""
    d = df.withWatermark(time, late) if df.isStreaming else df
    depth = F.round(r_to_depth(z_to_r(idecibel(dbz)), seconds), 6).cast("decimal(18,6)")
    out = d.groupBy(site, F.window(time, window).alias("w")).agg(F.sum(depth).cast("double").alias("depth"), F.count("*").alias("n"))
    return out.select(site, F.col("w.start").alias("start"), "depth", "n")
