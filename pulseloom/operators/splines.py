"""Smooth trends on B-splines: every degree of freedom from one pass over the rows, the best by AIC, a pointwise band."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.dist import t_reach

FREEDOM = (2, 3, 4, 5, 6)


def basis(u: np.ndarray, inner: Sequence[float], degree: int) -> np.ndarray:
    """The B-splines of [0, 1] with these inner knots at every u, a column each; by Cox and de Boor. They add up to 1."""
    t = np.concatenate([np.zeros(degree + 1), np.asarray(inner, float), np.ones(degree + 1)])
    u = np.clip(u, 0, 1)
    # The last interval that isn't empty takes 1 too.
    place = np.minimum(np.searchsorted(t, u, "right") - 1, np.flatnonzero(t < 1)[-1])
    b = (place[:, None] == np.arange(len(t) - 1)).astype(float)
    for p in range(1, degree + 1):
        left, right = t[p:-1] - t[: -p - 1], t[p + 1 :] - t[1:-p]
        up = np.divide(u[:, None] - t[: -p - 1], left, out=np.zeros((len(u), len(left))), where=left > 0)
        down = np.divide(t[p + 1 :] - u[:, None], right, out=np.zeros((len(u), len(right))), where=right > 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def _fits(df: DataFrame, x: str, y: str, freedom: Sequence[int]) -> tuple[float, float, list[dict]]:
    """least x, span, and per degree of freedom that can be fitted: knots, coefficients, their covariance, n, r2, aic, bic.

    Two aggregations: extremes and quantiles, then the sums of products of all bases. The driver solves matrices of 7 by 7 at most.
    """
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().where("not isnan(x) and not isnan(y)")
    wanted = sorted({(k + 1) / (f - 2) for f in freedom for k in range(f - 3)})
    cuts = F.percentile_approx("x", F.array(*map(F.lit, wanted or [0.5])), F.lit(10_000))
    s = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), cuts.alias("q"), F.avg("y").alias("m")).first()
    if s["lo"] is None:
        raise ValueError("no values to fit")
    lo, span, centre = s["lo"], (s["hi"] - s["lo"]) or 1.0, s["m"]
    at = dict(zip(wanted, s["q"], strict=False))
    shapes = []
    for f in freedom:
        inner = [(at[(k + 1) / (f - 2)] - lo) / span for k in range(f - 3)]
        shapes.append((f, min(3, f), inner))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0.0] * len(shapes)
        for b in batches:
            u, v = (b["x"].to_numpy() - lo) / span, b["y"].to_numpy() - centre
            for k, (_, degree, inner) in enumerate(shapes):
                z = np.column_stack([basis(u, inner, degree), v])
                total[k] = total[k] + np.append((z.T @ z).ravel(), len(u))
        if np.ndim(total[0]):
            yield pa.RecordBatch.from_pydict({"k": list(range(len(shapes))), "s": [t.tolist() for t in total]})

    got = d.mapInArrow(sums, "k long, s array<double>").select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).collect()  # 65 numbers a shape
    out = []
    for r in sorted(got):
        f, degree, inner = shapes[r["k"]]
        v = np.array([e["v"] for e in r["s"]])
        size, n = f + 1, v[-1]
        z = v[:-1].reshape(size + 1, size + 1)
        xx, xy, yy = z[:size, :size], z[:size, size], z[size, size]
        if n <= size or np.linalg.cond(xx) > 1e10:
            continue
        inverse = np.linalg.inv(xx)
        beta = inverse @ xy
        sse = max(float(yy - beta @ xy), 1e-12 * yy, 1e-300)
        like = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
        out.append({"df": f, "degree": degree, "inner": inner, "beta": beta + centre, "cov": inverse * sse / (n - size), "n": int(n), "r2": 1 - sse / yy if yy > 0 else 0.0, "aic": 2 * (size + 1) - 2 * like, "bic": (size + 1) * math.log(n) - 2 * like})
    return lo, span, out


def choices(df: DataFrame, x: str, y: str, freedom: Sequence[int] = FREEDOM) -> DataFrame:
    """df, n, r2, aic, bic and chosen of each degree of freedom that the values can carry."""
    fits = _fits(df, x, y, freedom)[2]
    best = min(fits, key=lambda f: (f["aic"], f["df"]), default=None)
    return df.sparkSession.createDataFrame([(f["df"], f["n"], float(f["r2"]), float(f["aic"]), float(f["bic"]), f is best) for f in fits], "df int, n long, r2 double, aic double, bic double, chosen boolean")


def trend(df: DataFrame, x: str, y: str, freedom: Sequence[int] = FREEDOM, points: int = 50, level: float = 0.95) -> DataFrame:
    """x, fitted, low, high on an even grid, and df, the degree of freedom of least AIC (the lesser in a tie).

    A fit of f degrees has f + 1 B-splines: cubic with f - 3 knots at quantiles of x, one polynomial below. low and high are the
    interval of the mean curve from the coefficients' covariance. Where no degree can be fitted (fewer than f + 2 rows, or than f + 1
    different x) it is the mean with its interval, and df is 0; no values are an error. Rows with a null or NaN aren't used.
    """
    lo, span, fits = _fits(df, x, y, freedom)
    u = np.linspace(0, 1, points)
    if fits:
        f = min(fits, key=lambda f: (f["aic"], f["df"]))
        b = basis(u, f["inner"], f["degree"])
        fitted, wide, rest, shown = b @ f["beta"], np.sqrt(np.maximum(0, ((b @ f["cov"]) * b).sum(1))), f["n"] - f["df"] - 1, f["df"]
    else:
        s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.avg(y).alias("m"), F.stddev_samp(y).alias("sd"), F.count("*").alias("n")).first()
        fitted, wide, rest, shown = np.full(points, s["m"]), np.full(points, (s["sd"] or 0.0) / math.sqrt(s["n"])), max(1, s["n"] - 1), 0
    reach = t_reach(np.array([level]), np.array([float(rest)]))[0] * wide
    rows = [(float(lo + span * v), float(m), float(m - r), float(m + r), shown) for v, m, r in zip(u, fitted, reach, strict=True)]
    return df.sparkSession.createDataFrame(rows, f"`{x}` double, fitted double, low double, high double, df int")
