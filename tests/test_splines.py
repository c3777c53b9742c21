"""B-spline trends against numpy least squares on the same basis."""

import numpy as np
import pytest

from pulseloom.operators import splines


def test_basis():
    u = np.linspace(0, 1, 101)
    for inner in ([], [0.5], [0.2, 0.2, 0.9]):
        b = splines.basis(u, inner, 3)
        assert b.shape == (101, len(inner) + 4) and np.allclose(b.sum(1), 1) and (b >= 0).all()
        assert b[0, 0] == 1 and b[-1, -1] == 1
    assert np.allclose(splines.basis(u, [], 2), np.column_stack([(1 - u) ** 2, 2 * u * (1 - u), u**2]))


def test_trend_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(10, 30, 240))
    y = np.sin(x / 3) * 4 + 100 + rng.normal(0, 0.5, 240)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (3.0, None), (12.0, float("nan"))], "x double, y double").repartition(3)
    rows = {r["df"]: r for r in splines.choices(df, "x", "y").collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6] and sum(r["chosen"] for r in rows.values()) == 1 and all(r["n"] == 240 for r in rows.values())
    best = next(f for f, r in rows.items() if r["chosen"])
    assert rows[best]["aic"] == min(r["aic"] for r in rows.values())
    lo, span, fits = splines._fits(df, "x", "y", splines.FREEDOM)
    for f in fits:
        b = splines.basis((x - lo) / span, f["inner"], f["degree"])
        beta, rest, *_ = np.linalg.lstsq(b, y, rcond=None)
        assert np.allclose(beta, f["beta"], rtol=1e-6) and np.isclose(1 - rest[0] / ((y - y.mean()) ** 2).sum(), f["r2"])
        assert np.allclose(f["cov"], np.linalg.inv(b.T @ b) * rest[0] / (240 - f["df"] - 1), rtol=1e-5)
    grid = splines.trend(df, "x", "y").collect()
    assert len(grid) == 50 and grid[0]["x"] == x[0] and grid[-1]["x"] == x[-1] and all(r["df"] == best for r in grid)
    inside = [r["low"] <= np.sin(r["x"] / 3) * 4 + 100 <= r["high"] for r in grid]
    assert all(r["low"] < r["fitted"] < r["high"] for r in grid) and (best < 6 or np.mean(inside) > 0.5)


def test_few_values(spark):
    one = splines.trend(spark.createDataFrame([(2.0, 5.0), (2.0, 7.0)], "x double, y double"), "x", "y", points=3).collect()
    assert [r["fitted"] for r in one] == [6.0] * 3 and one[0]["df"] == 0 and one[0]["low"] < 6 < one[0]["high"]
    assert splines.choices(spark.createDataFrame([(2.0, 5.0), (2.0, 7.0)], "x double, y double"), "x", "y").count() == 0
    flat = splines.trend(spark.createDataFrame([(float(k), 1.0) for k in range(30)], "x double, y double"), "x", "y").collect()
    assert all(abs(r["fitted"] - 1) < 1e-9 for r in flat)
    with pytest.raises(ValueError):
        splines.trend(spark.createDataFrame([], "x double, y double"), "x", "y")
