"""Post-hoc tests, power, normality votes, linear-model checks and filters against published or hand-made values."""

import math
import random

import pytest

from pulseloom.operators import align, hrv, inference


def test_studentized_range_against_the_table():
    for q, k, df in ((3.877, 3, 10), (4.327, 4, 10), (2.95, 2, 20), (3.314, 3, math.inf), (4.232, 5, 20)):
        assert abs(inference.studentized_range_upper(q, k, df) - 0.05) < 2e-3
    assert inference.studentized_range_upper(0.0, 3, 10) == 1.0 and inference.studentized_range_upper(50.0, 3, 10) < 1e-6


def test_power_against_published_values():
    assert abs(inference.t_power(0.5, 64) - 0.8015) < 2e-3 and abs(inference.t_power(0.5, 34, paired_=True) - 0.8078) < 2e-3
    assert inference.least_n(lambda n: inference.t_power(0.5, n)) == 64 and inference.least_n(lambda n: inference.t_power(0.5, n, paired_=True)) == 34
    assert inference.least_n(lambda n: inference.t_power(0.8, n)) == 26 and inference.least_n(lambda n: inference.anova_power(0.25, 3, n)) == 53
    assert abs(inference.t_power(1e-9, 30) - 0.05) < 1e-3 and abs(inference.anova_power(1e-9, 3, 30) - 0.05) < 1e-3


def test_power_of_comparisons(spark):
    d = spark.createDataFrame([("a", 0.5, 64), ("b", 0.0, 10), ("c", None, 5)], "name string, effect double, n int")
    got = {r["name"]: r for r in inference.power(d).collect()}
    assert abs(got["a"]["power"] - 0.8015) < 2e-3 and got["a"]["required_n"] == 64 and got["b"]["required_n"] is None and got["c"]["power"] is None or math.isnan(got["c"]["power"])
    with pytest.raises(ValueError):
        inference.power(d, "crossover")


def long_of(spark, groups):
    return spark.createDataFrame([("m", g, float(x)) for g, xs in groups.items() for x in xs], "metric string, grp string, value double")


def test_choice_follows_the_data(spark):
    rnd = random.Random(3)
    normal = {g: [rnd.gauss(100 + k, 15) for _ in range(200)] for k, g in enumerate("ab")}
    wide = {"a": normal["a"], "b": [rnd.gauss(100, 60) for _ in range(200)]}
    skewed = {g: [rnd.expovariate(1) for _ in range(200)] for g in "abc"}
    choose = lambda x, **k: inference.choose_test(long_of(spark, x), **k).first()
    assert choose(normal)["test"] == "student_t" and choose(wide)["test"] == "welch_t" and choose(skewed)["test"] == "kruskal"
    assert choose(skewed)["post_hoc"] == "dunn" and choose(normal, paired_=True)["test"] == "paired_t" and choose(skewed, paired_=True)["test"] == "friedman"
    votes = {r["grp"]: r for r in inference.normality(long_of(spark, {"n": normal["a"], "s": skewed["a"]})).collect()}
    assert votes["n"]["verdict"] == "normal" and votes["s"]["verdict"] == "not normal" and all(0 <= votes["n"][c] <= 1 for c in ("jb_p", "k2_p", "ks_p", "ad_p"))


def test_repeated_measures_by_hand(spark):
    rows = [("m", g, b, float(v)) for b, vs in enumerate(((45, 50, 55), (42, 42, 45), (36, 41, 43), (39, 35, 40), (51, 55, 59), (44, 49, 56))) for g, v in zip("abc", vs, strict=True)]
    d = spark.createDataFrame(rows, "metric string, grp string, block int, value double")
    r = inference.repeated_anova(d).first()
    assert abs(r["f"] - 12.53) < 0.01 and (r["df1"], r["df2"]) == (2, 10) and r["p_value"] < 0.002
    pair = {(x["a"], x["b"]): x for x in inference.paired(d).collect()}[("a", "c")]
    ds = [a - c for a, _, c in ((45, 50, 55), (42, 42, 45), (36, 41, 43), (39, 35, 40), (51, 55, 59), (44, 49, 56))]
    mean = sum(ds) / 6
    sd = math.sqrt(sum((x - mean) ** 2 for x in ds) / 5)
    assert abs(pair["t"] - mean / sd * math.sqrt(6)) < 1e-9 and pair["w_plus"] == 0 and pair["w_minus"] == 21


def test_linear_model_checks(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(800):
        x, b = rnd.random() * 10, rnd.random()
        rows.append((x, b, "u" if b < 0.5 else "v", 1 + 2 * x + 3 * b + 4 * x * b, x + rnd.gauss(0, 1), x + rnd.gauss(0, 1) * (0.2 + x)))
    rows.append((300.0, 0.5, "v", 0.0, -300.0, 0.0))
    d = spark.createDataFrame(rows, "x double, b double, s string, y double, even double, uneven double")
    plain = d.where("x < 100")
    terms = {r["term"]: r["coef"] for r in inference.interaction(plain, "y", "x", "b").collect()}
    assert all(abs(terms[k] - v) < 1e-6 for k, v in {"intercept": 1, "x": 2, "b": 3, "x:b": 4}.items())
    assert inference.white(plain, "even", ["x"]).first()["p_value"] > 0.01 and inference.white(plain, "uneven", ["x"]).first()["p_value"] < 1e-6
    slopes = {r["s"]: r["change_percent"] for r in inference.effect_modification(plain, "y", "x", "s").collect()}
    assert min(slopes.values()) > 10
    found = inference.influence(d, "even", ["x"]).first()
    assert found["n_leverage"] >= 1 and found["max_leverage"] > 0.5 and found["max_cook"] > 1


def test_rates_and_filters(spark):
    d = spark.createDataFrame([("s", k, k / 10, 5.0 + (k % 2)) for k in range(200)], "signal_id string, g int, t double, value double")
    down = {r["g"]: r["value"] for r in align.to_rate(d, 10, 2).collect()}
    assert len(down) == 40 and abs(sum(down.values()) / 40 - 5.5) < 0.01
    assert align.to_rate(d.where("g < 3"), 10, 20).count() == 4
    low = [r["filtered"] for r in align.filtered(d, align.filter_weights("low", 10, high=1, taps=21)).collect() if r["filtered"] is not None]
    high = [r["filtered"] for r in align.filtered(d, align.filter_weights("high", 10, low=1, taps=21)).collect() if r["filtered"] is not None]
    assert len(low) == 180 and all(abs(x - 5.5) < 0.02 for x in low) and all(abs(abs(x) - 0.5) < 0.02 for x in high)
    for bad in (("low", None, 6), ("low", None, None), ("band", 3, 2), ("high", 0, None), ("notch", 1, 2)):
        with pytest.raises(ValueError):
            align.filter_weights(bad[0], 10, bad[1], bad[2])


def test_extended_indices(spark):
    rr = [800.0, 820.0, 790.0, 830.0, 805.0, 845.0, 780.0]
    d = spark.createDataFrame([("s", 1, k + 1, x) for k, x in enumerate(rr)], "subject string, sol int, i int, rr double")
    got = hrv.extended(d).first()
    pairs = list(zip(rr, rr[1:], strict=False))
    sd = lambda xs: math.sqrt(sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs)) / math.sqrt(2)
    s1, s2 = sd([b - a for a, b in pairs]), sd([b + a for a, b in pairs])
    assert abs(got["csi"] - s2 / s1) < 1e-9 and abs(got["cvi"] - math.log10(16 * s1 * s2)) < 1e-9 and abs(got["modified_csi"] - 4 * s2 * s2 / s1) < 1e-6 and got["range_nn"] == 65


def test_isolation_forest_finds_planted_outliers(spark):
    import numpy as np

    from pulseloom.operators.models import isolation_outliers

    rnd = np.random.default_rng(3)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(rnd.normal(size=(950, 2)))] + [(1000 + k, float(a), float(b)) for k, (a, b) in enumerate(rnd.normal(8, 1, size=(50, 2)) * np.where(rnd.random((50, 2)) < 0.5, 1, -1))]
    d = spark.createDataFrame([*rows, (5000, None, 1.0)], "id int, a double, b double")
    got = {r["id"]: r for r in isolation_outliers(d, ["a", "b"], ["id"], 0.05).collect()}
    out = {k for k, r in got.items() if r["outlier"]}
    assert len(got) == 1001 and abs(len(out) - 50) <= 1 and len(out & set(range(1000, 1050))) >= 47
    assert got[5000]["score"] is None and not got[5000]["outlier"]
    again = {r["id"]: r["score"] for r in isolation_outliers(d.repartition(3), ["a", "b"], ["id"], 0.05).collect()}
    assert all(again[k] == r["score"] for k, r in got.items())
    assert isolation_outliers(d.limit(0), ["a", "b"], ["id"]).count() == 0
    same = spark.createDataFrame([(k, 1.0) for k in range(20)], "id int, a double")
    assert isolation_outliers(same, ["a"], ["id"]).where("outlier").count() == 0


def test_power_of_many_rows_meets_that_of_fewer(monkeypatch):
    """The limiting laws against the exact ones where both can be had."""
    for d, n in ((0.02, 9_000), (0.05, 8_000), (0.0, 9_500)):
        exact, f = inference.t_power(d, n), inference.anova_power(d / 2, 3, 6_000)
        monkeypatch.setattr(inference, "LARGE", 1_000)
        assert abs(inference.t_power(d, n) - exact) < 1e-3 and abs(inference.anova_power(d / 2, 3, 6_000) - f) < 1e-3
        monkeypatch.undo()
    assert 0.8 <= inference.t_power(0.001, inference.least_n(lambda m: inference.t_power(0.001, m))) < 0.8001


def test_power_uses_the_groups_own_sizes(spark):
    rows = [("m", "a", float(k % 7), 1) for k in range(40)] + [("m", "b", float(k % 7) + 1, 1) for k in range(120)]
    long = spark.createDataFrame(rows, "metric string, grp string, value double, n int")
    (r,) = inference.pairwise_power(long).collect()
    assert r["n"] == 2 * 40 * 120 / 160 and abs(r["power"] - inference.t_power(r["effect"], 60)) < 1e-9
    (g,) = inference.groups_power(long).collect()
    assert g["n"] == 80 and abs(g["power"] - inference.anova_power(g["effect"], 2, 80)) < 1e-9
