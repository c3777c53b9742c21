"""Exact k nearest neighbours of every row, and the local outlier factor.

Distinct points (with how many rows they stand for) are dealt to the leaves of a k-d tree, cut at medians of a bounded sample, so
leaves hold about LEAF points wherever the data are dense. Each leaf finds its points' neighbours within itself; the k-th of these
bounds how far a better one can be, and only points whose ball of that radius crosses into other leaves are asked for there. The
answers are merged per point. Within a leaf, points lie in blocks of a few hundred, and blocks farther than the k-th neighbour found
so far are left out. No pair of rows is ever written but a point and one of its k best of a leaf.

The sample only decides where leaves end: at most SAMPLE points by hash, on the driver. Results are exact for every tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.lineage import remove, settle

LEAF, SAMPLE, BLOCK = 4096, 100_000, 256


class Tree:
    """A full binary tree of cuts: node i has the children 2 i + 1 (below the cut) and 2 i + 2 (from the cut on)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(leaves - 1).bit_length())
        self.axis, self.cut = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        parts = [sample]
        for level in range(self.depth):
            below = []
            for k, part in enumerate(parts):
                at = (1 << level) - 1 + k
                if len(part):
                    self.axis[at] = int(np.argmax(np.ptp(part, axis=0)))
                    self.cut[at] = np.median(part[:, self.axis[at]])
                left = part[:, self.axis[at]] < self.cut[at]
                below += [part[left], part[~left]]
            parts = below

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - ((1 << self.depth) - 1)

    def crossed(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: every leaf that the ball of the radius around a row touches."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            gap = x[row, self.axis[node]] - self.cut[node]
            left, right = gap - radius[row] < 0, gap + radius[row] >= 0
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - ((1 << self.depth) - 1)


class Blocks:
    """The points of a leaf in blocks with their bounding boxes."""

    def __init__(self, x: np.ndarray):
        self.x, waiting, self.members = x, [np.arange(len(x))], []
        while waiting:
            own = waiting.pop()
            if len(own) <= BLOCK:
                if len(own):
                    self.members.append(own)
                continue
            order = own[np.argsort(x[own, int(np.argmax(np.ptp(x[own], axis=0)))], kind="stable")]
            waiting += [order[: len(own) // 2], order[len(own) // 2 :]]
        self.low = np.array([x[m].min(0) for m in self.members]).reshape(-1, x.shape[1])
        self.high = np.array([x[m].max(0) for m in self.members]).reshape(-1, x.shape[1])

    def nearest(self, asked: np.ndarray, same: np.ndarray, tie: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: none) and distances of the k nearest points within each asked row's bound; `same` is the row's own number, or -1."""
        numbers, far = np.full((len(asked), k), -1), np.full((len(asked), k), np.inf)
        for group in Blocks(asked).members if len(asked) else []:
            q = asked[group]
            gap = np.maximum(0, np.maximum(self.low - q.max(0), q.min(0) - self.high))
            away = np.sqrt((gap**2).sum(1))
            for b in np.argsort(away, kind="stable"):
                if away[b] > np.minimum(far[group, k - 1], bound[group]).max():
                    break
                m = self.members[b]
                d = np.sqrt(((q[:, None, :] - self.x[m][None, :, :]) ** 2).sum(2))
                d[(m[None, :] == same[group][:, None]) | (d > bound[group][:, None])] = np.inf
                d = np.concatenate([far[group], d], 1)
                n = np.concatenate([numbers[group], np.broadcast_to(m, (len(group), len(m)))], 1)
                order = np.lexsort((np.where(n < 0, np.iinfo(np.int64).max, tie[n]), d), axis=1)[:, :k]
                far[group], numbers[group] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
        return np.where(np.isinf(far), -1, numbers), far


POINT = "leaf int, p long, tie long, w long, x array<double>"
FOUND = "p long, q long, qw long, tie long, distance double"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(p: np.ndarray, points: pa.Table, numbers: np.ndarray, far: np.ndarray) -> pa.Table:
    row, place = np.nonzero(numbers >= 0)
    q = numbers[row, place]
    take = lambda name: pa.array(points[name].to_numpy()[q])
    return pa.table({"p": pa.array(p[row]), "q": take("p"), "qw": take("w"), "tie": take("tie"), "distance": pa.array(far[row, place])})


def nearest(df: DataFrame, features: Sequence[str], k: int = 20, leaf: int = LEAF, trash: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct points (p, w rows, the features as x0, x1, ...) and their neighbours (p, q, w, distance): k rows each, counted by w.

    A point's own other rows are neighbours at distance 0. Equal distances go by a hash of the features; of the last point as many rows
    are taken as k leaves room for. Rows without one of the features are no points. Both tables are settled under `trash`.
    """
    spark, spent, width = df.sparkSession, [], len(features)
    names = [f"x{i}" for i in range(width)]
    d = df.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]).dropna()
    d = d.groupBy(*names).agg(F.count("*").alias("w"))
    points = settle(d.select(F.monotonically_increasing_id().alias("p"), F.xxhash64(*names).alias("tie"), "w", *names), trash)
    n = points.count()
    share = max(1, -(-n // SAMPLE))
    sample = points.where(F.pmod("tie", F.lit(share)) == 0).select(*names).limit(2 * SAMPLE).toArrow() if n > leaf else None
    drawn = np.column_stack([sample[c].to_numpy() for c in names]) if sample is not None else np.zeros((0, width))
    tree = Tree(drawn, max(1, min(-(-n // leaf), len(drawn) // 32)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(3), width)
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(x).astype(np.int32)), *b.columns], names=["leaf", "p", "tie", "w", "x"])

    def within(t: pa.Table) -> pa.Table:
        x, own = _matrix(t["x"], width), np.arange(t.num_rows)
        numbers, far = Blocks(x).nearest(x, own, t["tie"].to_numpy(), k, np.full(len(x), np.inf))
        return _rows(t["p"].to_numpy(), t, numbers, far)

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, radius = _matrix(b.column(2), width), b.column(3).to_numpy(zero_copy_only=False)
            row, leaves = tree.crossed(x, radius)
            keep = leaves != b.column(0).to_numpy()[row]
            which = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(leaves[keep].astype(np.int32)), b.column(1).take(which), b.column(2).take(which), b.column(3).take(which)], names=["leaf", "p", "x", "radius"])

    def answer(points: pa.Table, asked: pa.Table) -> pa.Table:
        numbers, far = Blocks(_matrix(points["x"], width)).nearest(_matrix(asked["x"], width), np.full(asked.num_rows, -1), points["tie"].to_numpy(), k, asked["radius"].to_numpy())
        return _rows(asked["p"].to_numpy(), points, numbers, far)

    dealt = settle(points.select("p", "tie", "w", F.array(*names).alias("x")).mapInArrow(assign, POINT), spent)
    near = settle(dealt.groupBy("leaf").applyInArrow(within, FOUND), spent)
    if tree.depth:
        radius = near.groupBy("p").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("radius"))
        asked = dealt.select("leaf", "p", "x").join(radius, "p", "left").select("leaf", "p", "x", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        asked = asked.mapInArrow(abroad, "leaf int, p long, x array<double>, radius double")
        near = near.union(dealt.groupBy("leaf").cogroup(asked.groupBy("leaf")).applyInArrow(answer, FOUND))
    own = points.where("w > 1").select("p", F.col("p").alias("q"), (F.col("w") - 1).alias("qw"), F.lit(None).cast("long").alias("tie"), F.lit(0.0).alias("distance"))
    best = near.union(own).groupBy("p").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "tie", "q", "qw"))), 1, k).alias("best"))
    ahead = lambda i: F.aggregate(F.slice("best", 1, i), F.lit(0).cast("long"), lambda a, b: a + b["qw"])
    took = best.select("p", F.inline(F.transform("best", lambda b, i: F.struct(b["q"].alias("q"), F.least(b["qw"], k - ahead(i)).alias("w"), b["distance"].alias("distance"))))).where("w > 0")
    out = settle(took, trash)
    remove(spark, spent)
    return points, out


def local_outlier_factor(df: DataFrame, features: Sequence[str], k: int = 20, share: float = 0.1, leaf: int = LEAF, trash: list[str] | None = None) -> DataFrame:
    """df with lof (about 1 within a cluster, high where a row is sparser than its k neighbours) and outlier, the `share` of highest factors.

    Rows without one of the features have a null lof and are no outliers; where a row has fewer than k others, all of them count.
    """
    points, near = nearest(df, features, k, leaf, trash)
    reach = near.groupBy("p").agg(F.max("distance").alias("k_distance"))
    dense = near.join(reach.withColumnRenamed("p", "q"), "q").groupBy("p").agg((F.sum(F.col("w") * F.greatest("distance", "k_distance")) / F.sum("w")).alias("reach"))
    dense = settle(dense.select("p", (1 / (F.col("reach") + 1e-10)).alias("density")), trash)
    around = near.join(dense.toDF("q", "around"), "q").groupBy("p").agg((F.sum(F.col("w") * F.col("around")) / F.sum("w")).alias("around"))
    names = [f"x{i}" for i in range(len(features))]
    scored = points.join(around, "p").join(dense, "p").select(*[F.col(n).alias(f"lof_{n}") for n in names], (F.col("around") / F.col("density")).alias("lof"))
    same = [df[f].cast("double") == F.col(f"lof_{n}") for f, n in zip(features, names, strict=True)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = df.join(scored, on, "left").drop(*[f"lof_{n}" for n in names])
    limit = out.agg(F.percentile_approx("lof", F.lit(1 - share), F.lit(10000)).alias("lof_limit"))
    out = out.join(F.broadcast(limit))  # one row
    return out.withColumn("outlier", F.coalesce(F.col("lof") > F.col("lof_limit"), F.lit(False))).drop("lof_limit")
