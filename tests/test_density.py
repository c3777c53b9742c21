"""Density clusters and components against plain code."""

import glob

import numpy as np

from pulseloom.functions import lineage
from pulseloom.functions.components import components
from pulseloom.operators import density as module
from pulseloom.operators.density import density


def brute(rows, eps, least):
    x = np.array([r[1:] for r in rows], float)
    near = ((x[:, None] - x) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in label:
            best = min(label[j] for j in np.flatnonzero(near[i] & core))
            changed, label[i] = changed or best < label[i], best
    return {r[0]: str(min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)) for i, r in enumerate(rows)}


def check(spark, x, eps, least):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    names = [f"f{k}" for k in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["cluster"] for r in density(df, names, eps, least, "id").collect()}
    assert got == brute(rows, eps, least)
    return got


def test_four_dimensions_with_noise_and_repeats(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 0.3, (60, 4)), rng.normal(2, 0.3, (60, 4)), rng.uniform(-3, 5, (60, 4)), np.ones((9, 4)) * -2])
    assert len(set(check(spark, x, 0.55, 5).values())) > 3


def test_dense_cells_through_their_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "DIRECT", 0)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.uniform(0, 1, (150, 2)), rng.uniform(0, 1, (150, 2)) + [1.45, 0], rng.uniform(0, 1, (100, 2)) + [0, 1.6]])
    check(spark, x, 0.5, 4)


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.0, float("nan")), (3, 0.0, 0.0), (4, -0.0, 0.0), (5, 9.0, 9.0)], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in density(df, ["x", "y"], 0.5, 2, "id").collect()}
    assert got == {1: "-1", 2: "-1", 3: "3", 4: "3", 5: "-1"}
    assert density(df.where("false"), ["x", "y"], 0.5, 2, "id").count() == 0


def test_components_of_a_long_chain(spark):
    before = set(glob.glob(f"{lineage.shared_dir(spark)}/pulseloom-*"))
    n = 3000
    order = np.random.default_rng(2).permutation(n)
    links = [(int(order[k]), int(order[k + 1])) for k in range(n - 1)] + [(5000, 5001), (7, 7), (None, 3)]
    trash = []
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), trash).collect()}
    assert len(got) == n + 2 and all(got[k] == 0 for k in range(n)) and got[5001] == 5000 and len(trash) == 1
    lineage.remove(spark, trash)
    assert set(glob.glob(f"{lineage.shared_dir(spark)}/pulseloom-*")) == before
