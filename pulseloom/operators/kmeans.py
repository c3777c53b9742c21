"""K-means for many numbers of clusters and many starts at once: each pass over the rows serves all models that still move.

Rows are first brought to distinct points with their counts, kept as a table. A pass folds a partition's batches into sums a centre;
Spark adds these up, and the driver sees a row a centre. Nothing is drawn by place or task, so reruns give the same models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.lineage import settle

STEPS, TOLERANCE = 50, 1e-4


@dataclass
class Model:
    """Centres as rows, and the inertia of all points around them."""

    k: int
    seed: int
    centres: np.ndarray
    inertia: float = float("inf")


def points(df: DataFrame, features: Sequence[str], trash: list[str]) -> DataFrame:
    """at, n, h: the distinct points without nulls or NaN, how many rows each is, and a hash of it."""
    at = [F.col(f).cast("double") + 0.0 for f in features]
    whole = F.lit(True)
    for c in at:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    d = df.where(whole).groupBy(F.array(*at).alias("at")).agg(F.count("*").alias("n"))
    return settle(d.withColumn("h", F.xxhash64("at")), trash)


def _fold(d: DataFrame, step: Callable, rows: Callable, schema: str) -> DataFrame:
    """The rows of each partition's state, where state = step(state, x, n, h) over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                x = b["at"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                state = step(state, x, b["n"].to_numpy(zero_copy_only=False), b["h"].to_numpy(zero_copy_only=False).view(np.uint64))
        if state is not None:
            yield from pa.table(rows(state)).to_batches()

    return d.mapInArrow(run, schema)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres, column by column, so near points lose no digits."""
    out = np.zeros((len(x), len(c)))
    for f in range(x.shape[1]):
        out += (x[:, f, None] - c[None, :, f]) ** 2
    return out


def _uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number over 0 and up to 1 for each hash, seed and step, by multiply and shift (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15 + (step + 1) * 0xD1B54A32D192ED03) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 1) / 2**53


def starts(d: DataFrame, k: int, seeds: Sequence[int]) -> dict[int, np.ndarray]:
    """k centres a seed, each drawn with a chance of count x squared distance to those before it: one pass a centre for all seeds.

    The draw is a race: the least exponential variate over the weight wins, which partitions can settle among themselves. Where there
    are fewer distinct points than k, a seed has as many centres as points.
    """
    chosen: dict[int, np.ndarray] = {}
    for j in range(k):
        now = dict(chosen)

        def step(state, x, n, h, now=now, j=j):
            best = state or {}
            for s in seeds:
                weight = n * (_squared(x, now[s]).min(1) if j else 1.0)
                with np.errstate(divide="ignore"):
                    key = np.where(weight > 0, -np.log(_uniform(h, s, j)) / weight, np.inf)
                at = int(key.argmin())
                if np.isfinite(key[at]):
                    mine = (float(key[at]), x[at].tolist())
                    best[s] = min(best.get(s, mine), mine)
            return best

        def rows(best):
            return {"seed": pa.array(list(best), pa.int64()), "key": pa.array([v[0] for v in best.values()], pa.float64()), "at": pa.array([v[1] for v in best.values()], pa.list_(pa.float64()))}

        won = _fold(d, step, rows, "seed long, key double, at array<double>").groupBy("seed").agg(F.min(F.struct("key", "at")).alias("w")).collect()
        if not won:
            break
        chosen |= {r["seed"]: np.vstack([*([chosen[r["seed"]]] if j else []), [r["w"]["at"]]]) for r in won}
    return chosen


def _sums(d: DataFrame, models: Sequence[Model]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each model the count, the sum, the sum of squares and the squared distances of every centre's points; one pass, one aggregation."""
    given = [m.centres for m in models]
    owner = np.repeat(np.arange(len(given)), [len(c) for c in given])
    cluster = np.concatenate([np.arange(len(c)) for c in given])
    width = given[0].shape[1]

    def step(state, x, n, h):
        s = np.zeros((len(owner), width + 3)) if state is None else state
        first = 0
        for c in given:
            far = _squared(x, c)
            near = far.argmin(1)
            for v, col in ((n, 0), (n * (x**2).sum(1), 1), (n * far[np.arange(len(x)), near], 2), *((n * x[:, f], 3 + f) for f in range(width))):
                s[first : first + len(c), col] += np.bincount(near, v, len(c))
            first += len(c)
        return s

    def rows(s):
        return {"model": owner, "cluster": cluster, "s": pa.array(s.tolist(), pa.list_(pa.float64()))}

    got = _fold(d, step, rows, "model long, cluster long, s array<double>").groupBy("model", "cluster").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width + 3)]).alias("s")).collect()
    out = [np.zeros((len(c), width + 3)) for c in given]
    for r in got:
        out[r["model"]][r["cluster"]] = r["s"]
    return [(s[:, 0], s[:, 3:], s[:, 1], s[:, 2]) for s in out]


def search(d: DataFrame, ks: Sequence[int], seeds: Sequence[int], steps: int = STEPS, tolerance: float = TOLERANCE) -> dict[int, Model]:
    """The model of least inertia for every k, over all seeds. d is points(); all (k, seed) models move in the same passes.

    A seed's start for k are its first k centres. An emptied centre stays where it is. A model stops when no coordinate of its centres
    moves by more than the tolerance, or after `steps` moves. Ties go to the first seed; centres are in the order of their coordinates.
    """
    begun = starts(d, max(ks), seeds)
    models = [Model(k, s, begun[s][:k]) for k in ks for s in seeds if s in begun]
    active = models
    for step in range(steps + 1):
        if not active:
            break
        moving = []
        for m, (n, total, _, cost) in zip(active, _sums(d, active), strict=True):
            m.inertia = float(cost.sum())
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], m.centres)
            if step < steps and np.abs(new - m.centres).max() > tolerance:
                m.centres = new
                moving.append(m)
        active = moving
    best = {}
    for m in models:
        if m.k not in best or m.inertia < best[m.k].inertia:
            best[m.k] = m
    for m in best.values():
        m.centres = m.centres[np.lexsort(m.centres.T[::-1])]
    return best


def measures(d: DataFrame, models: Sequence[Model]) -> list[dict[str, float]]:
    """silhouette (of squared distances), calinski_harabasz, davies_bouldin and inertia of every model, in two passes for all.

    All are taken around the clusters' means. Empty clusters don't count; a measure without two clusters is null.
    """
    sums = _sums(d, models)
    given = [m.centres for m in models]

    def step(state, x, n, h):
        out = [np.zeros((len(c), 2)) for c in given] if state is None else state
        norm = (x**2).sum(1)
        for c, (size, total, squares, _), s in zip(given, sums, out, strict=True):
            near, live = _squared(x, c).argmin(1), size > 0
            count = np.maximum(size, 1)
            to = norm[:, None] * size + squares - 2 * x @ total.T  # of a point to all points of a cluster, squared and summed
            rows = np.arange(len(x))
            own = np.maximum(0, to[rows, near]) / np.maximum(1, size[near] - 1)
            other = np.where(live, to / count, np.inf)
            other[rows, near] = np.inf
            other = np.maximum(0, other.min(1))
            top = np.maximum(own, other)
            with np.errstate(invalid="ignore"):
                sil = np.where((size[near] > 1) & (top > 0) & np.isfinite(other), (other - own) / np.where(top > 0, top, 1), 0)
            s[:, 0] += np.bincount(near, n * sil, len(c))
            s[:, 1] += np.bincount(near, n * np.sqrt(((x - (total / count[:, None])[near]) ** 2).sum(1)), len(c))
        return out

    def rows(out):
        return {"model": np.repeat(np.arange(len(out)), [len(s) for s in out]), "cluster": np.concatenate([np.arange(len(s)) for s in out]), "a": np.concatenate([s[:, 0] for s in out]), "b": np.concatenate([s[:, 1] for s in out])}

    got = _fold(d, step, rows, "model long, cluster long, a double, b double").groupBy("model", "cluster").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    spread = [np.zeros((len(c), 2)) for c in given]
    for r in got:
        spread[r["model"]][r["cluster"]] = r["a"], r["b"]
    out = []
    for (size, total, squares, _), s in zip(sums, spread, strict=True):
        live = size > 0
        n, k = size.sum(), int(live.sum())
        mean = total[live] / size[live][:, None]
        within = float(np.maximum(0, squares[live] - (mean**2).sum(1) * size[live]).sum())
        between = float((size[live] * ((mean - total.sum(0) / n) ** 2).sum(1)).sum())
        row = {"silhouette": None, "calinski_harabasz": None, "davies_bouldin": None, "inertia": within}
        if k > 1:
            apart, wide = np.sqrt(_squared(mean, mean)), s[live, 1] / size[live]
            np.fill_diagonal(apart, np.inf)
            row |= {"silhouette": float(s[:, 0].sum() / n), "davies_bouldin": float(((wide[:, None] + wide) / apart).max(1).mean())}
            row["calinski_harabasz"] = float(between / (k - 1) / (within / (n - k))) if n > k and within > 0 else None
        out.append(row)
    return out


def nearest(model: Model, features: Sequence[str]) -> Column:
    """The number of the nearest centre, the lesser one in a tie; null where a feature is null or NaN."""
    far = lambda c: sum(((F.col(f).cast("double") - float(v)) ** 2 for f, v in zip(features, c, strict=True)), F.lit(0.0))
    least = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(model.centres)]))
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return F.when(whole, least["k"])
