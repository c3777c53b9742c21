"""Windowed heart-rate metrics over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.clean import range_null


def windowed_heart_rate(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """subject, start, n, mean_hr, min_hr, max_hr per event-time window; samples later than the watermark are left out. Batch tables work too."""
    d = stream.select("subject", F.col("ts").cast("timestamp").alias("ts"), range_null(F.col("hr")).alias("hr")).where("hr is not null")
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    w = d.groupBy("subject", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg("hr").alias("mean_hr"), F.min("hr").alias("min_hr"), F.max("hr").alias("max_hr"))
    return w.select("subject", F.col("w.start").alias("start"), "n", "mean_hr", "min_hr", "max_hr")
