"""Shuffles that keep group sizes and bootstraps of quantiles."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import stats

LONG = "metric string, grp string, value double, n int"


def test_shuffles_move_exactly_the_first_groups_rows(spark):
    rnd = np.random.default_rng(1)
    rows = [("m", float(v), int(c), 57) for v, c in enumerate(rnd.integers(1, 9, 60))] + [("k", 1.0, 5, 2), ("k", 2.0, 1, 2)]
    d = spark.createDataFrame(rows, "metric string, value double, c long, na long")
    total = sum(r[2] for r in rows[:60])
    for slices in (1, 7, 64):
        got = stats.shuffles(d, 500, 3, slices)
        sizes = {(r["metric"], r["n"]) for r in got.select("metric", "n").distinct().collect()}
        assert sizes == {("m", 57), ("k", 2)} and got.count() == 1000
        own = np.array([r["s"] for r in got.where("metric = 'm'").collect()])
        values = np.repeat([r[1] for r in rows[:60]], [r[2] for r in rows[:60]])
        mean, spread = 57 * values.mean(), np.sqrt(57 * values.var() * (total - 57) / (total - 1))
        assert abs(own.mean() - mean) < 5 * spread / np.sqrt(500) and 0.85 < own.std() / spread < 1.15


def test_p_against_all_splits(spark):
    x, y = [1.0, 2.0, 2.0, 7.0, 9.0, 3.0], [4.0, 8.0, 9.0, 11.0, 2.0, 12.0]
    every = x + y
    seen = abs(np.mean(x) - np.mean(y))
    hits = [abs(sum(c) / 6 - (sum(every) - sum(c)) / 6) >= seen - 1e-9 for c in itertools.combinations(every, 6)]
    d = spark.createDataFrame([("m", "a", v, 1) for v in x] + [("m", "b", v, 1) for v in y] + [("m", "b", None, 1), ("m", "c", 99.0, 1)], LONG)
    one = stats.permutation(d, "a", "b", reps=20_000).first()
    want = np.mean(hits)
    assert abs(one["difference"] - (np.mean(x) - np.mean(y))) < 1e-12
    assert abs(one["p_value"] - want) < 4 * np.sqrt(want * (1 - want) / 20_000)
    assert stats.permutation(d.repartition(7), "a", "b", reps=20_000).first()["p_value"] == one["p_value"]


def test_more_rows_than_numpy_draws():
    g = np.random.default_rng(1)
    got = stats._without_replacement(g, 3_000_000_000, np.full(2000, 6_000_000_000), np.full(2000, 900_000_000))
    spread = np.sqrt(9e8 * (1 / 3) * (2 / 3) * (8.1 / 9))
    assert abs(got.mean() - 3e8) < 5 * spread / np.sqrt(2000) and 0.9 < got.std() / spread < 1.1


@pytest.mark.parametrize("slices", [2, 9, 256])
def test_quantiles_of_the_same_draws(spark, slices):
    """Against weighted samples written out, drawn from the same hashes."""
    rnd = np.random.default_rng(4)
    rows = [("m", ["a", "b"][k % 3 == 0], float(np.round(v, 1)), 1) for k, v in enumerate(rnd.normal(5, 2, 400))] + [("m", "one", 3.0, 1), ("m", None, 1.0, 1), ("m", None, 2.0, 1), ("m", "a", None, 1)]
    d = spark.createDataFrame(rows, LONG).repartition(3)
    reps, quantiles = 60, (0.1, 0.5, 0.75)
    hashes = d.where("value is not null").groupBy("metric", "grp", "value").agg(F.count("*").alias("c")).select("grp", "value", "c", F.xxhash64("metric", "grp", "value", F.lit(7)).alias("h")).collect()
    got = {(r["grp"], r["quantile"]): r for r in stats.bootstrap_quantiles(d, quantiles, reps, slices=slices).collect()}
    assert len(got) == 12
    for grp in ("a", "b", "one", None):
        own = sorted((r["value"], np.random.default_rng(r["h"] % (1 << 64)).poisson(r["c"], reps)) for r in hashes if r["grp"] == grp)
        drawn = [np.repeat([v for v, _ in own], [n[k] for _, n in own]) for k in range(reps)]
        for q in quantiles:
            s = [np.quantile(x, q) for x in drawn if len(x)]
            r = got[grp, q]
            np.testing.assert_allclose([r["low"], r["high"]], np.quantile(s, [0.025, 0.975]), rtol=1e-9)
            assert abs(r["estimate"] - np.quantile([x[2] for x in rows if x[1] == grp and x[2] is not None], q)) < 1e-9
