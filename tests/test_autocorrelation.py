"""Autocorrelation over blocks of rows."""

import numpy as np
import pytest

from pulseloom.operators import timeagg


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_autocorrelation_crosses_blocks_without_a_join(spark):
    rnd = np.random.default_rng(5)
    x = {g: rnd.normal(size=n).cumsum() for g, n in (("a", 331), ("b", 7))}
    d = spark.createDataFrame([(g, i + 1, float(v)) for g, xs in x.items() for i, v in enumerate(xs)], "g string, i int, x double")
    out = timeagg.autocorrelation(d, ("g",), lags=12, rows=50)
    assert "Join" not in plan(out)
    got = {(r["g"], r["lag"]): r["acf"] for r in out.collect()}
    want = {}
    for g, xs in x.items():
        c = xs - xs.mean()
        want |= {(g, k): (c[: len(c) - k] * c[k:]).sum() / (c * c).sum() for k in range(min(13, len(c)))}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_autocorrelation_of_gaps_and_nulls(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("a", 6, 8.0)], "g string, i int, x double")
    got = {r["lag"]: r["acf"] for r in timeagg.autocorrelation(d, ("g",), lags=5, rows=2).collect()}
    assert got == {0: 1.0, 1: None, 2: pytest.approx(3 / 26), 3: pytest.approx(-4 / 26), 4: None, 5: pytest.approx(-12 / 26)}
