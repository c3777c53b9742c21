"""Descriptive tables, intervals, correlation tables, factors in subgroups."""

import math

import numpy as np
import pytest

from pulseloom.functions.dist import t_reach, t_two_sided
from pulseloom.operators import hrv, models, stats


def test_reach_of_t():
    got = t_reach(np.array([0.95, 0.95, 0.99, 0.9]), np.array([10.0, 1.0, 30.0, 1e6]))
    assert np.allclose(got, [2.228139, 12.706205, 2.749996, 1.644855], atol=2e-5)
    assert np.allclose(t_two_sided(got, np.array([10.0, 1.0, 30.0, 1e6])), [0.05, 0.05, 0.01, 0.1])


def test_interval_of_a_difference(spark):
    x, y = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 9.0]
    d = spark.createDataFrame([("m", "a", v) for v in x] + [("m", "b", v) for v in y] + [("m", "b", None)], "metric string, grp string, value double")
    r = stats.t_test(d, "a", "b", True).first()
    se = math.sqrt((np.var(x, ddof=1) * 3 + np.var(y, ddof=1) * 3) / 6 / 2)
    assert math.isclose(r["se"], se) and math.isclose(r["difference"], -2.75) and math.isclose(r["high"] - r["low"], 2 * 2.446912 * se, rel_tol=1e-6)
    one = stats.t_test(spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0)], "metric string, grp string, value double"), "a", "b").first()
    assert one["difference"] == -1 and (one["low"] is None or math.isnan(one["low"]))


def test_kolmogorov_p(spark):
    d = spark.createDataFrame([("m", "a", float(k)) for k in range(100)] + [("m", "b", float(k) + 20.5) for k in range(100)] + [("same", g, float(k)) for g in "ab" for k in range(50)], "metric string, grp string, value double")
    r = {x["metric"]: x for x in stats.ks_two_sample(d, "a", "b").collect()}
    x = 0.21 * math.sqrt(50)
    assert math.isclose(r["m"]["d"], 0.21) and math.isclose(r["m"]["p_value"], 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 50)), rel_tol=1e-9)
    assert r["same"]["d"] == 0 and r["same"]["p_value"] == 1


def test_percentiles_of_a_description(spark):
    v = np.random.default_rng(4).normal(size=300)
    r = stats.describe(spark.createDataFrame([("m", "g", float(x)) for x in v] + [("m", "g", None)], "metric string, grp string, value double")).first()
    assert all(math.isclose(r[f"p{p}"], np.percentile(v, p)) for p in stats.PERCENTILES) and r["n"] == 300
    q1, q3 = np.percentile(v, [25, 75])
    assert math.isclose(r["lower_bound"], q1 - 1.5 * (q3 - q1)) and r["n_outliers"] == int(((v < r["lower_bound"]) | (v > r["upper_bound"])).sum())


def test_ordered_matrix(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [tuple(map(float, x)) for x in zip(a, b, a + 0.1 * rng.normal(size=200), b + 0.2 * rng.normal(size=200), rng.normal(size=200), strict=True)]
    got = stats.ordered_matrix(spark.createDataFrame(rows, "a double, b double, a2 double, b2 double, z double"), ["a", "b", "a2", "b2", "z"]).collect()
    at = {r["a"]: r["a_at"] for r in got}
    assert len(got) == 25 and sorted(at.values()) == list(range(5)) and abs(at["a"] - at["a2"]) == 1 and abs(at["b"] - at["b2"]) == 1
    assert all(r["r"] == 1 for r in got if r["a"] == r["b"]) and {(r["a"], r["b"]): r["r"] for r in got}["a", "z"] == {(r["a"], r["b"]): r["r"] for r in got}["z", "a"]
    flat = stats.ordered_matrix(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), ["x", "y"]).where("a <> b").collect()
    assert [r["r"] for r in flat] == [None, None]


def test_strongest_pairs(spark):
    d = spark.createDataFrame([(float(k), float(-k), float(k % 7), None) for k in range(50)], "a double, b double, c double, e double")
    got = stats.strongest(stats.correlations(d, ["a", "b", "c", "e"]), 10, 0.3).collect()
    assert [(r["a"], r["b"], r["strength"], r["direction"]) for r in got] == [("a", "b", "strong", "negative")]
    assert stats.correlations(d, ["a"], ["b", "c"]).count() == 2


def test_factor_models_and_subgroups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(2 * x + (5 if g == "u" else 0) + 0.1 * rng.normal())) for g, n in (("u", 60), ("v", 40), ("w", 10)) for x in rng.normal(size=n)] + [(None, 1.0, 1.0), ("u", None, 3.0)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    sub = {r["level"]: r for r in models.subgroup_lines(d, ["y"], ["x"], ["g"]).collect()}
    assert set(sub) == {"u", "v"} and sub["u"]["n"] == 60 and abs(sub["v"]["slope"] - 2) < 0.1 and sub["v"]["r"] > 0.99
    fit = {(r["model"], r["term"]): r for r in models.factor_model(d, ["y"], ["x"], ["g"]).collect()}
    assert ("adjusted", "g=v") in fit and ("adjusted", "g=u") not in fit and abs(fit["adjusted", "g=v"]["coef"] + 5) < 0.2
    assert fit["adjusted", "x"]["r2"] > 0.99 > fit["crude", "x"]["r2"] and fit["crude", "x"]["n"] == fit["adjusted", "x"]["n"] == 110
    told = models.insights(d, ["y"], ["x"], ["g"]).collect()
    assert [r["kind"] for r in told] == ["association", "model"] and told[0]["finding"].startswith("strong positive association of y and x")
    none = models.insights(d.where("false"), ["y"], ["x"])
    assert none.count() == 0


def test_table_set_takes_what_there_is(spark):
    d = spark.createDataFrame([("a", 1, 10.126, 3.0)], "subject string, sol int, sdnn double, sd1 double")
    assert hrv.table_set(d, "time").columns == ["subject", "sol", "sdnn"] and hrv.table_set(d, "time").first()["sdnn"] == 10.13
    assert hrv.table_set(d, "complete").columns == d.columns
    with pytest.raises(ValueError):
        hrv.table_set(d, "frequency")
    with pytest.raises(ValueError):
        hrv.table_set(d, "nothing")
