"""Joins: external context, signals on a common grid, positional pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulseloom.functions.ordered import beside, framed, numbered


def merge_external(df: DataFrame, others: dict[str, DataFrame], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Left joins one source after the other; columns that df has already get _name; a source without the keys is left out."""
    for name, other in others.items():
        if not set(keys) <= set(other.columns):
            continue
        taken = set(df.columns) - set(keys)
        df = df.join(other.select(*keys, *[F.col(c).alias(f"{c}_{name}" if c in taken else c) for c in other.columns if c not in keys]), list(keys), "left")
    return df


def match_rate(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before, matched rows before the join, and their share."""
    hit = df.select(*keys).join(other.select(*keys).distinct().withColumn("hit", F.lit(1)), list(keys), "left")
    return hit.agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_matched")).withColumn("match_rate", F.col("n_matched") / F.col("n_rows"))


def on_grid(signals: DataFrame, hz: float, keys: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Every signal at multiples of 1 / hz within its own range, linearly between samples: keys, g, value."""
    d = beside(signals.select(*keys, "t", "value"), keys, ["t"], {"t2": "t", "v2": "value"}).where("t2 > t")
    d = d.withColumns({"low": F.ceil(F.col("t") * hz), "high": F.ceil(F.col("t2") * hz) - 1}).where("low <= high")
    d = d.withColumn("g", F.explode(F.sequence("low", "high")))
    return d.select(*keys, "g", (F.col("value") + (F.col("g") / hz - F.col("t")) / (F.col("t2") - F.col("t")) * (F.col("v2") - F.col("value"))).alias("value"))


def to_rate(signals: DataFrame, from_hz: float, to_hz: float, keys: Sequence[str] = ("signal_id",)) -> DataFrame:
    """keys, g, value at multiples of 1 / to_hz: means of buckets where the rate goes down, lines between samples where it goes up."""
    if from_hz <= 0 or to_hz <= 0:
        raise ValueError("rates are over 0")
    if to_hz >= from_hz:
        return on_grid(signals, to_hz, keys)
    return signals.groupBy(*keys, F.floor(F.col("t") * to_hz).alias("g")).agg(F.avg("value").alias("value"))


def filter_weights(kind: str, hz: float, low: float | None = None, high: float | None = None, taps: int = 33) -> list[float]:
    """Weights of a windowed-sinc low-, high- or band-pass; `low` and `high` are its edges in Hz, below half the rate."""
    edges = {"low": (high,), "high": (low,), "band": (low, high)}.get(kind)
    if edges is None:
        raise ValueError(f"kind is low, high or band, not {kind}")
    if any(e is None or not 0 < e < hz / 2 for e in edges) or (kind == "band" and low >= high):
        raise ValueError("edges lie between 0 and half the rate, the lower one first")
    if taps < 3 or taps % 2 == 0:
        raise ValueError("taps are odd, 3 at least")
    at = np.arange(taps) - taps // 2
    pass_below = lambda edge: (lambda w: w / w.sum())(np.sinc(2 * edge / hz * at) * np.hamming(taps))
    one = (at == 0).astype(float)
    weights = pass_below(high) if kind == "low" else one - pass_below(low) if kind == "high" else pass_below(high) - pass_below(low)
    return weights.tolist()


def filtered(signals: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("signal_id",), order: str = "g", value: str = "value") -> DataFrame:
    """filtered: the weighted sum around each row; null where the window isn't full."""
    half = len(weights) // 2

    def columns(w: WindowSpec) -> dict[str, Column]:
        total = None
        for k, weight in enumerate(weights):
            x = (F.lag(value, half - k).over(w) if k < half else F.lead(value, k - half).over(w) if k > half else F.col(value)) * float(weight)
            total = x if total is None else total + x
        return {"filtered": total}

    return framed(signals, keys, order, columns, half, half)


def align(a: DataFrame, b: DataFrame, hz: float) -> DataFrame:
    """Pairs of values of two signals (t, value) on the grid of their common range: an equi-join on the grid's index."""
    one = on_grid(a.withColumn("signal_id", F.lit(0)), hz).select("g", F.col("value").alias("value_a"))
    other = on_grid(b.withColumn("signal_id", F.lit(1)), hz).select("g", F.col("value").alias("value_b"))
    return one.join(other, "g").select("g", (F.col("g") / hz).alias("t"), "value_a", "value_b")


def pair_by_position(df: DataFrame, group: str, value: str, order: Sequence[str], a: str, b: str) -> DataFrame:
    """position, x, y: the k-th values of two groups; what one has more than the other is left out."""
    d = df.where(F.col(group).isin(a, b)).select(group, value, *order)
    d = numbered(d, [group], order, "position")
    return d.where(F.col(group) == a).select("position", F.col(value).alias("x")).join(d.where(F.col(group) == b).select("position", F.col(value).alias("y")), "position")
