"""ARIMA fits against planted models and plain recursions."""

import numpy as np
import pytest

from pulseloom.operators import arima


def frame(spark, **series):
    return spark.createDataFrame([(k, i, float(y)) for k, ys in series.items() for i, y in enumerate(ys)], "series_id string, i long, y double").repartition(4)


def made(n, constant=0.0, ar=(), ma=(), seed=1, sd=1.0):
    e = np.random.default_rng(seed).normal(0, sd, n + 200)
    y = np.zeros(n + 200)
    for t in range(len(y)):
        y[t] = constant + e[t] + sum(a * y[t - j] for j, a in ar if t >= j) + sum(b * e[t - j] for j, b in ma if t >= j)
    return y[200:], e[200:]


def test_recovers_a_planted_model(spark):
    """ARMA(1, 1) with 0.7 and 0.4: standard errors at 4,000 steps are about 0.015 and 0.02; the bound is 0.06."""
    y, _ = made(4000, 3.0, [(1, 0.7)], [(1, 0.4)])
    (fit,) = arima.fits(frame(spark, a=y), [(1, 0, 1, 0, 0, 0)]).collect()
    assert fit["terms"] == ["z1", "e1"]
    assert abs(fit["beta"][1] - 0.7) < 0.06 and abs(fit["beta"][2] - 0.4) < 0.06 and abs(fit["beta"][0] - 3) < 0.6
    assert abs(fit["sse"] / fit["n"] - 1) < 0.08


def test_recovers_a_planted_season(spark):
    y, _ = made(3000, 0.0, [(12, 0.6)], [(1, 0.5)])
    (fit,) = arima.fits(frame(spark, a=y), [(0, 0, 1, 1, 0, 0)], period=12).collect()
    assert fit["terms"] == ["z12", "e1"] and abs(fit["beta"][1] - 0.6) < 0.06 and abs(fit["beta"][2] - 0.5) < 0.06
    wave = 10 * np.sin(2 * np.pi * np.arange(240) / 12) + np.arange(240) * 0.5 + np.random.default_rng(4).normal(0, 0.3, 240)
    out = arima.arima(frame(spark, w=wave), [(0, 0, 1, 0, 1, 1), (0, 1, 1, 0, 1, 1)], period=12, steps=24).orderBy("i").collect()
    want = 10 * np.sin(2 * np.pi * np.arange(240, 264) / 12) + np.arange(240, 264) * 0.5
    assert [r["i"] for r in out] == list(range(240, 264)) and all(r["sd"] == 1 for r in out)
    assert np.abs(np.array([r["forecast"] for r in out]) - want).max() < 1.5
    assert out[0]["high"] - out[0]["low"] < out[-1]["high"] - out[-1]["low"] and all(r["low"] < r["forecast"] < r["high"] for r in out)


def test_chooses_orders_per_series(spark):
    first, _ = made(1500, 0.0, [(1, 0.8)], [], 2)
    second, _ = made(1500, 0.0, [], [(1, 0.9)], 3)
    walk = np.cumsum(made(1500, 0.2, [], [], 5)[0])
    best = {r["series_id"]: r for r in arima.arima(frame(spark, ar=first, ma=second, walk=walk), steps=1).collect()}
    assert best["ar"]["d"] == 0 and best["ar"]["p"] >= 1 and best["ma"]["q"] >= 1 and best["ma"]["d"] == 0
    assert all(0.9 < r["rmse"] < 1.1 and 0.7 < r["mae"] < 0.9 and r["bic"] > r["aic"] for r in best.values())
    assert abs(best["walk"]["forecast"] - walk[-1]) < 3


@pytest.mark.parametrize("order", [(2, 1, 1, 0, 0, 0), (1, 0, 2, 0, 0, 0), (1, 1, 1, 1, 1, 1), (0, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0)])
def test_forecasts_follow_the_recursion(spark, order):
    """Forecasts and bands of the fitted coefficients by a plain loop over the undifferenced equation."""
    period, y = 4, np.cumsum(made(160, 0.1, [(1, 0.5)], [(1, 0.3)], 7)[0]) + np.tile([1, 5, 2, 0], 40)
    df = frame(spark, a=y)
    (fit,) = arima.fits(df, [order], period).collect()
    out = arima.arima(df, [order], period, steps=6).orderBy("i").collect()
    a, b = arima._polynomials(order, fit["terms"], fit["beta"], period)
    e = np.zeros(len(y))
    for t in range(len(a) - 1, len(y)):
        e[t] = a @ y[t - len(a) + 1 : t + 1][::-1] - fit["beta"][0] - sum(b[j] * e[t - 1 - j] for j in range(len(b)) if t > j)
    ys, es, want = list(y), list(e), []
    for _ in range(6):
        es.append(0.0)
        ys.append(fit["beta"][0] - sum(a[j] * ys[-j] for j in range(1, len(a))) + sum(b[j] * es[-2 - j] for j in range(len(b))))
        want.append(ys[-1])
    np.testing.assert_allclose([r["forecast"] for r in out], want, rtol=1e-7)
    sigma = np.sqrt(np.mean(e[len(y) - fit["n"] :] ** 2))
    unit = np.zeros(len(a) + 6)  # the answer to one unit innovation
    for t in range(6):
        unit[len(a) + t] = (1.0 if t == 0 else b[t - 1] if t <= len(b) else 0.0) - sum(a[j] * unit[len(a) + t - j] for j in range(1, len(a)))
    spread = np.sqrt(np.cumsum(unit[len(a) :] ** 2)) * sigma * 1.959964
    np.testing.assert_allclose([r["high"] - r["forecast"] for r in out], spread, rtol=1e-7)


def test_short_and_constant_series(spark):
    out = arima.arima(frame(spark, short=[1, 2, 3], none=[], flat=[5.0] * 60), steps=2).collect()
    assert {r["series_id"] for r in out} == {"flat"} and all(abs(r["forecast"] - 5) < 1e-6 for r in out)


def test_fits_are_stationary_and_invertible(spark):
    beta = np.array([0.0, 0.5, 2.0])
    assert arima._settled(["z1", "e1"], beta) and beta.tolist() == [0.0, 0.5, 0.5]
    two = np.r_[0.0, np.poly([2.0, 0.5])[1:]]
    assert arima._settled(["e1", "e2"], two) and np.allclose(two[1:], np.poly([0.5, 0.5])[1:])
    assert not arima._settled(["z1"], np.array([0.0, 1.01])) and not arima._settled(["e1", "e12"], np.array([0.0, 0.1, 1.5]))
    series = {f"s{k}": made(60, 1.0, [(1, 0.99)], [(1, -1.2)], k)[0] for k in range(8)}
    out = arima.arima(frame(spark, **series), steps=3).collect()
    assert len(out) == 24 and all(r["rmse"] < 3 and abs(r["forecast"]) < 1000 for r in out)
