"""Nearest neighbours and local outlier factors against all distances."""

import numpy as np
import pytest

from pulseloom.operators import neighbours


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    far = np.take_along_axis(d, near, 1)
    reach = np.maximum(far, far[:, -1][near])
    density = 1 / (reach.mean(1) + 1e-10)
    return far, density[near].mean(1) / density


@pytest.mark.parametrize(("n", "k", "leaf"), [(2000, 20, 100), (2000, 5, 5000), (300, 7, 40), (12, 20, 4096)])
def test_factors_of_all_rows(spark, monkeypatch, n, k, leaf):
    rnd = np.random.default_rng(n + k)
    x = np.concatenate([rnd.normal(0, 1, (n // 2, 3)), rnd.normal(8, 0.1, (n - n // 2 - 3, 3)), [[3.0, 3, 3], [-9, 0, 4], [50, 50, 50]]])
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(-1, None, 1.0, 1.0)], "id long, a double, b double, c double").repartition(4)
    out = neighbours.local_outlier_factor(df, ["a", "b", "c"], k, leaf=leaf)
    got = {r["id"]: r for r in out.collect()}
    assert out.columns == ["id", "a", "b", "c", "lof", "outlier"] and len(got) == n + 1 and got[-1]["lof"] is None and not got[-1]["outlier"]
    _, want = brute(x, k)
    np.testing.assert_allclose([got[i]["lof"] for i in range(n)], want, rtol=1e-9)
    flagged = sum(r["outlier"] for r in got.values())
    if n > k:
        assert got[n - 1]["outlier"] and 0.05 * n <= flagged <= 0.1 * n + 1


def test_repeated_rows_are_neighbours_of_each_other(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 1, (40, 2))
    rows = np.concatenate([x, np.repeat(x[:1], 9, 0), np.repeat(x[1:3], 3, 0)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "id long, a double, b double")
    out = {r["id"]: r["lof"] for r in neighbours.local_outlier_factor(df, ["a", "b"], 5, leaf=10).collect()}
    _, want = brute(rows, 5)
    np.testing.assert_allclose([out[i] for i in range(len(rows))], want, rtol=1e-9)
    points, near = neighbours.nearest(df, ["a", "b"], 5, leaf=10)
    assert points.count() == 40 and all(r["s"] == 5 for r in near.groupBy("p").agg({"w": "sum"}).toDF("p", "s").collect())


def test_one_place_and_no_rows(spark):
    same = spark.createDataFrame([(1.0,)] * 500, "a double")
    assert {round(r["lof"], 9) for r in neighbours.local_outlier_factor(same, ["a"], 5, leaf=10).collect()} == {1.0}
    assert neighbours.local_outlier_factor(same.where("a > 1"), ["a"], 5).count() == 0
    assert [r["lof"] for r in neighbours.local_outlier_factor(same.limit(1), ["a"], 5).collect()] == [None]


def test_balls_reach_every_leaf_they_touch():
    rnd = np.random.default_rng(2)
    x, q = rnd.random((3000, 2)), rnd.random((200, 2))
    tree, radius = neighbours.Tree(x[:1000], 16), rnd.random(200) * 0.2
    row, leaf = tree.crossed(q, radius)
    touched = set(zip(row.tolist(), leaf.tolist(), strict=True))
    inside = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)) <= radius[:, None]
    assert {(i, int(tree.leaf(x[j : j + 1])[0])) for i, j in zip(*np.nonzero(inside), strict=True)} <= touched
    assert tree.depth == 4 and len(touched) == len(row)
