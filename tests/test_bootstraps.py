"""Resampled beats: their joins, and intervals against draws put in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import models


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _beats(spark):
    return spark.range(600).select(F.when(F.col("id") < 350, "a").otherwise("b").alias("subject"), (F.when(F.col("id") < 350, F.col("id")).otherwise(F.col("id") - 350) + 1).cast("int").alias("i"), (F.lit(800.0) + (F.col("id") * 7919) % 211).alias("rr"))


def test_resampled_beats_are_no_broadcast(spark):
    rr = _beats(spark)
    assert "BroadcastHashJoin" not in plan(models.resampled(rr, ("subject",), 3)).split("== Physical Plan ==")[1]
    assert models.resampled(rr, ("subject",), 3).count() == 1800


def test_bootstrap_intervals_without_order_or_broadcast(spark):
    rr = _beats(spark)
    out = models.bootstrap_intervals(rr, ("subject",), 9)
    physical = plan(out).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" not in physical and "lag(" not in physical
    draws = models.resampled(rr, ("subject",), 9).toPandas().sort_values(["subject", "rep", "i"])
    for row in out.collect():
        own = draws[draws.subject == row["subject"]].groupby("rep").rr
        rmssd = own.apply(lambda x: np.sqrt((np.diff(x) ** 2).mean()))
        assert row["rmssd_low"] == pytest.approx(np.quantile(rmssd, 0.025)) and row["rmssd_high"] == pytest.approx(np.quantile(rmssd, 0.975))
        assert row["sdnn_low"] == pytest.approx(np.quantile(own.std(), 0.025))
