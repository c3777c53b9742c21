"""Sample tables: subject, sol, t (seconds), seq (tie breaker), hr. Mappings from other tables onto it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """One subject per event type, one sol per day; hr = 40 + value."""
    ts = F.col("ts").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)
    return events.select(
        F.col("event_type").alias("subject"),
        (F.floor(micros / 86_400_000_000) + 1).cast("int").alias("sol"),
        ts.alias("ts"),
        (micros / 1e6).alias("t"),
        F.col("event_id").alias("seq"),
        (F.col("value") + 40).alias("hr"),
    )


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))
