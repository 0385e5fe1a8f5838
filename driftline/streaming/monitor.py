"""Statistics of a running simulation from a stream of per-generation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(rows: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, key, n, mean, sd by windows of time; rows later than `late` are left out. Works on streams and tables."""
    # a watermark needs a time with a zone
    watched = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows
    out = watched.groupBy(F.window("ts", width), "key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "key", "n", "mean", "sd")
