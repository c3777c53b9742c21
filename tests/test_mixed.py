"""Mixed models against closed forms and the likelihood of the whole covariance matrix."""

import math

import numpy as np

from pulseloom.operators.mixed import mixed_model


def likelihood(rows, beta, g, s2, slopes):
    total = 0.0
    for own in rows.values():
        y, x = np.array([r[0] for r in own]), np.array([[1.0, r[1]] for r in own])
        zz = x if slopes else x[:, :1]
        v = zz @ g @ zz.T + s2 * np.eye(len(y))
        e = y - x[:, : len(beta)] @ beta
        total -= 0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e))
    return total


def made(sizes, slope_sd=0.0, seed=1):
    rnd = np.random.default_rng(seed)
    rows = {}
    for k, n in enumerate(sizes):
        a, b = rnd.normal(0, 2), rnd.normal(0, slope_sd) if slope_sd else 0.0
        x = rnd.uniform(0, 4, n)
        rows[f"g{k}"] = [(float(10 + a + (1.5 + b) * t + rnd.normal(0, 1)), float(t)) for t in x]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "x") for k, own in rows.items() for r in own] + [("g0", None, 1.0, "x"), ("g1", 1.0, None, "x")], "who string, y double, x double, n string").repartition(3)


def test_balanced_intercepts_equal_the_closed_form(spark):
    rnd = np.random.default_rng(3)
    y = rnd.normal(5, 1, (12, 8)) + rnd.normal(0, 2, (12, 1))
    df = spark.createDataFrame([(k, float(v)) for k, own in enumerate(y) for v in own], "who long, y double")
    terms, effects = mixed_model(df, "y", [], "who")
    t = {(r["part"], r["term"]): r for r in terms.collect()}
    within, between = y.var(1, ddof=1).mean(), 8 * y.mean(1).var(ddof=1)
    g = ((1 - 1 / 12) * between - within) / 8
    one = t["fixed", "intercept"]
    assert one["converged"] and one["n"] == 96 and one["groups"] == 12
    np.testing.assert_allclose([one["value"], t["random", "intercept"]["value"], t["random", "residual"]["value"], one["icc"]], [y.mean(), g, within, g / (g + within)], rtol=1e-4)
    np.testing.assert_allclose(one["se"], math.sqrt((within + 8 * g) / 96), rtol=1e-4)
    shrink = g / (g + within / 8)
    got = {r["group"]: r["intercept"] for r in effects.collect()}
    np.testing.assert_allclose([got[k] for k in range(12)], shrink * (y.mean(1) - y.mean()), rtol=1e-3, atol=1e-6)


def test_slopes_reach_the_highest_likelihood(spark):
    rows = made([5, 9, 30, 1, 14, 22, 8, 40, 3, 12, 17, 25], 0.8, 5)
    terms, effects = mixed_model(frame(spark, rows), "y", ["x"], "who", ["x"])
    t = {(r["part"], r["term"]): r for r in terms.collect()}
    beta = np.array([t["fixed", "intercept"]["value"], t["fixed", "x"]["value"]])
    g = np.array([[t["random", "intercept"]["value"], t["random", "intercept:x"]["value"]], [t["random", "intercept:x"]["value"], t["random", "x"]["value"]]])
    s2, top = t["random", "residual"]["value"], t["fixed", "x"]["log_likelihood"]
    assert abs(top - likelihood(rows, beta, g, s2, True)) < 1e-6 and t["fixed", "x"]["converged"]
    rnd = np.random.default_rng(0)
    for _ in range(60):  # no small step in any direction is better
        d, e = rnd.normal(0, 0.01, 2), rnd.normal(0, 0.01, (2, 2))
        assert likelihood(rows, beta + d, g + (e + e.T) / 2 * 0.3, s2 * math.exp(rnd.normal(0, 0.01)), True) < top + 1e-6
    assert t["fixed", "x"]["low"] < 1.5 < t["fixed", "x"]["high"] and t["fixed", "x"]["p_value"] < 0.01
    assert effects.count() == 12 and effects.columns == ["group", "intercept", "x"]


def test_no_differences_between_groups_and_few_rows(spark):
    rnd = np.random.default_rng(9)
    rows = {f"g{k}": [(float(rnd.normal()), float(x)) for x in range(6)] for k in range(6)}
    terms, _ = mixed_model(frame(spark, rows), "y", ["x"], "who")
    t = {(r["part"], r["term"]): r for r in terms.collect()}
    assert 0 <= t["random", "intercept"]["value"] < 0.2 and abs(t["random", "residual"]["value"] - 1) < 0.6
    few, none = mixed_model(frame(spark, {"g0": rows["g0"], "g1": rows["g1"]}), "y", ["x"], "who")
    assert few.count() == 0 and none.count() == 0 and few.columns == terms.columns
