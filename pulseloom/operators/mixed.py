"""Linear mixed models with random intercepts and slopes by expectation-maximisation over one small row a group.

Each group's rows are read once, as the products of its columns. Every iteration is one pass over these rows, a group each; what
comes to the driver is a sum of small matrices. The fit is maximum likelihood (not REML), sped up by squared extrapolation, which only
ever takes steps that raise the likelihood.

Defined results: rows without one of the columns are left out; fewer than `least` rows give no result; a group of one row counts; a
column that doesn't vary shares its coefficient with the intercept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.dist import p_t
from pulseloom.functions.lineage import remove, settle


def _group_sums(df: DataFrame, y: str, fixed: Sequence[str], group: str) -> DataFrame:
    """group, n, products: of (1, fixed, y), the upper triangle."""
    names = ["c0", *[f"c{k}" for k in range(1, len(fixed) + 2)]]
    d = df.select(F.col(group).alias("group"), F.lit(1.0).alias("c0"), *[F.col(c).cast("double").alias(n) for c, n in zip([*fixed, y], names[1:], strict=True)]).dropna()
    return d.groupBy("group").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for k, a in enumerate(names) for b in names[k:]]).alias("products"))


def _unpacked(batch: pa.RecordBatch, at: int, size: int) -> np.ndarray:
    flat = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
    out = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _posterior(m: np.ndarray, z: list[int], beta: np.ndarray, g: np.ndarray, s2: float):
    """For groups' products m: A = Z'Z, c = Z'(y - X beta), r'r, the random effects and their covariances, (s2 I + A G)^-1."""
    x = list(range(len(beta)))
    a, zx = m[:, z][:, :, z], m[:, z][:, :, x]
    c = m[:, z, len(beta)] - zx @ beta
    rr = m[:, -1, -1] - 2 * m[:, x, len(beta)] @ beta + np.einsum("i,nij,j->n", beta, m[:, x][:, :, x], beta)
    inner = np.linalg.inv(s2 * np.eye(len(z)) + a @ g)
    b = np.einsum("ij,njk,nk->ni", g, inner, c)
    return a, zx, c, rr, inner, b, s2 * g @ inner


def _step(sums: DataFrame, size: int, z: list[int], theta: tuple[np.ndarray, np.ndarray, float]) -> tuple[float, tuple[np.ndarray, np.ndarray, float], np.ndarray]:
    """The log likelihood at theta = (beta, G, s2), the next theta, and the information on beta."""
    beta, g, s2 = theta
    k, q = len(beta), len(z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(0).to_numpy(), _unpacked(batch, 1, size)
            a, zx, c, rr, inner, b, cov = _posterior(m, z, beta, g, s2)
            weight = np.einsum("ij,njk->nik", g, inner)
            info = (m[:, :k, :k] - np.einsum("nji,njk,nkl->nil", zx, weight, zx)).sum(0) / s2
            score = (m[:, :k, k] - np.einsum("nji,njk,nk->ni", zx, weight, m[:, z, k])).sum(0) / s2
            quad = (rr - np.einsum("ni,nij,nj->n", c, weight, c)) / s2
            like = -0.5 * (n * math.log(2 * math.pi * s2) + np.linalg.slogdet(np.eye(q) + a @ g / s2)[1] + quad).sum()
            rest = (rr - 2 * (b * c).sum(1) + np.einsum("ni,nij,nj->n", b, a, b) + np.einsum("nij,nji->n", a, cov)).sum()
            spread = (b[:, :, None] * b[:, None, :] + cov).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[like, rest, n.sum(), len(n)], info.ravel(), score, spread.ravel()])], pa.list_(pa.float64()))], names=["part"])

    parts = sums.select("n", "products").mapInArrow(run, "part array<double>").toArrow()["part"].to_pylist()
    total = np.sum(parts, axis=0)
    info, score = total[4 : 4 + k * k].reshape(k, k), total[4 + k * k : 4 + k * k + k]
    return float(total[0]), (np.linalg.pinv(info) @ score, total[4 + k * k + k :].reshape(q, q) / total[3], max(1e-300, float(total[1] / total[2]))), info


def _flat(theta: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    return np.concatenate([theta[0], theta[1][np.tril_indices(len(theta[1]))], [math.log(theta[2])]])


def _theta(flat: np.ndarray, k: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    g = np.zeros((q, q))
    g[np.tril_indices(q)] = flat[k:-1]
    g = g + np.tril(g, -1).T
    value, vector = np.linalg.eigh(g)
    return flat[:k], vector @ np.diag(np.maximum(value, 1e-12 * max(1e-300, value.max()))) @ vector.T, math.exp(min(600.0, flat[-1]))


def mixed_model(df: DataFrame, y: str, fixed: Sequence[str], group: str, random: Sequence[str] = (), least: int = 20, rounds: int = 200, tolerance: float = 1e-10, trash: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: terms and random effects.

    Terms: part (fixed or random), term, value, se, z, p_value, low, high, n, groups, log_likelihood, aic, bic, icc, converged. Fixed parts are
    coefficients; random parts are variances ("intercept", a slope's name), covariances ("a:b") and "residual". Random slopes are of fixed
    columns. Random effects: group and a column for the intercept and each slope. Sums a group are settled under `trash`.
    """
    z = [0, *[list(fixed).index(c) + 1 for c in random]]
    spark, k, q = df.sparkSession, len(fixed) + 1, len(z)
    sums = settle(_group_sums(df, y, fixed, group), trash)
    zs = ["intercept", *random]
    kind = "part string, term string, value double, se double, n long, groups long, log_likelihood double, aic double, bic double, icc double, converged boolean"
    whole = sums.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), *[F.sum(F.col("products")[i]).alias(f"m{i}") for i in range((k + 1) * (k + 2) // 2)]).first()
    effects = ", ".join(["`group` " + sums.schema["group"].dataType.simpleString(), *[f"`{c}` double" for c in zs]])
    if (whole["n"] or 0) < least:
        none = spark.createDataFrame([], kind)
        return _judged(none), spark.createDataFrame([], effects)
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = [whole[f"m{i}"] for i in range((k + 1) * (k + 2) // 2)]
    m = m + np.triu(m, 1).T
    beta = np.linalg.pinv(m[:k, :k]) @ m[:k, k]
    s2 = max(1e-12, float(m[k, k] - beta @ m[:k, k]) / whole["n"])
    scale = np.array([m[i, i] / whole["n"] for i in z])
    theta, best, done = (beta, np.diag(s2 / 2 / np.maximum(scale, 1e-12)), s2 / 2), -math.inf, False
    for _ in range(rounds):
        like, one, info = _step(sums, k + 1, z, theta)
        if abs(like - best) <= tolerance * (1 + abs(like)):
            done = True
            break
        best = like
        like_one, two, _ = _step(sums, k + 1, z, one)
        p0, p1, p2 = _flat(theta), _flat(one), _flat(two)
        r, v = p1 - p0, p2 - 2 * p1 + p0
        far = max(1.0, float(np.linalg.norm(r) / max(1e-300, np.linalg.norm(v))))
        leap = _theta(p0 + 2 * far * r + far * far * v, k, q)
        like_leap, after, _ = _step(sums, k + 1, z, leap)
        theta = after if math.isfinite(like_leap) and like_leap >= like_one else two
    beta, g, s2 = theta
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(info))))
    count = k + q * (q + 1) // 2 + 1
    told = (int(whole["n"]), int(whole["groups"]), like, 2 * count - 2 * like, count * math.log(whole["n"]) - 2 * like, float(g[0, 0] / (g[0, 0] + s2)), done)
    rows = [("fixed", t, float(b), float(s), *told) for t, b, s in zip(["intercept", *fixed], beta, se, strict=True)]
    rows += [("random", zs[i] if i == j else f"{zs[j]}:{zs[i]}", float(g[i, j]), None, *told) for i in range(q) for j in range(i + 1)]
    rows.append(("random", "residual", s2, None, *told))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _posterior(_unpacked(batch, 1, k + 1), z, beta, g, s2)[5]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(b[:, i]) for i in range(q)]], names=["group", *zs])

    return _judged(spark.createDataFrame(rows, kind)), sums.select("group", "products").mapInArrow(predicted, effects)


def _judged(terms: DataFrame) -> DataFrame:
    z = F.when(F.col("se") > 0, F.col("value") / F.col("se"))
    half = 1.959964 * F.col("se")
    out = terms.withColumns({"z": z, "p_value": p_t(z, F.lit(1e7)), "low": F.col("value") - half, "high": F.col("value") + half})
    return out.select("part", "term", "value", "se", "z", "p_value", "low", "high", "n", "groups", "log_likelihood", "aic", "bic", "icc", "converged")
