"""Many k-means models in the same passes, against plain numpy and pyspark's evaluator."""

import math

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler

from pulseloom.operators import cluster
from pulseloom.operators import kmeans as many


def blobs(spark, parts=3):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.6, (70, 3)) for c in ([0, 0, 0], [5, 0, 1], [0, 5, 2], [5, 5, -3])])
    rows = [tuple(map(float, r)) for r in x] + [(0.5, 0.25, 0.125)] * 40
    return spark.createDataFrame(rows, "z_a double, z_b double, z_c double").repartition(parts), np.array(rows)


def lloyd(x, c):
    for _ in range(many.STEPS + 1):
        far = ((x[:, None] - c) ** 2).sum(2)
        near = far.argmin(1)
        new = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        if np.abs(new - c).max() <= many.TOLERANCE:
            break
        c = new
    return far.min(1).sum()


def test_all_models_in_one_search_equal_each_on_its_own(spark):
    df, x = blobs(spark)
    d = many.points(df, ["z_a", "z_b", "z_c"], [])
    seeds, ks = [1, 2, 3], [2, 3, 4, 6]
    begun, best = many.starts(d, 6, seeds), many.search(d, ks, seeds)
    assert all(len({tuple(c) for c in begun[s]}) == 6 and all((x == c).all(1).any() for c in begun[s]) for s in seeds)
    for k in ks:
        assert math.isclose(best[k].inertia, min(lloyd(x, begun[s][:k]) for s in seeds), rel_tol=1e-9)
    other = many.search(many.points(df.repartition(7), ["z_a", "z_b", "z_c"], []), ks, seeds)
    assert all(np.allclose(best[k].centres, other[k].centres) for k in ks)


def test_measures_equal_evaluator_and_group_sums(spark):
    df, _ = blobs(spark)
    d = many.points(df, ["z_a", "z_b", "z_c"], [])
    best = many.search(d, [3, 4], [1, 2])
    for k, got in zip(best, many.measures(d, list(best.values())), strict=True):
        labelled = df.withColumn("cluster", many.nearest(best[k], ["z_a", "z_b", "z_c"]))
        v = VectorAssembler(inputCols=["z_a", "z_b", "z_c"], outputCol="features").transform(labelled)
        assert math.isclose(got["silhouette"], ClusteringEvaluator(predictionCol="cluster").evaluate(v), rel_tol=1e-6)
        want = cluster.validate(labelled, ["a", "b", "c"]).first()
        assert all(math.isclose(got[c], want[c], rel_tol=1e-6) for c in ("calinski_harabasz", "davies_bouldin", "inertia"))


def test_draws_follow_the_weights(spark):
    d = spark.createDataFrame([([0.0], 1, 1), ([1.0], 9, 2)], "at array<double>, n long, h long")
    first = many.starts(d, 1, list(range(400)))
    assert 0.85 < np.mean([first[s][0, 0] for s in first]) < 0.95


def test_few_points_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (4.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "z_a double, z_b double")
    got = cluster.kmeans(df.coalesce(1), ["a", "b"], 3, [1]).collect()
    assert [r["cluster"] is None for r in got] == [False] * 3 + [True] * 2 and len({r["cluster"] for r in got[:3]}) == 2
    rows = cluster.choose_k(df, ["a", "b"], range(2, 5), [1]).collect()
    assert [r["k"] for r in rows] == [2] and rows[0]["inertia"] == 0 and rows[0]["calinski_harabasz"] is None
    empty = df.where("false")
    assert cluster.kmeans(empty, ["a", "b"], 2).count() == 0 and cluster.choose_k(empty, ["a", "b"]).count() == 0
