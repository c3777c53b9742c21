"""Seasonal ARIMA per series by Hannan-Rissanen, orders chosen by AIC, forecasts of several steps with widening bands.

Rows are (series_id, i from 0 without gaps, y). Differences are taken first, (1 - B)^d (1 - B^s)^D. A long autoregression gives first
innovations; values and innovations at their lags are then regressed on together. One aggregation per (d, D) holds the products of all
lags that any order uses, so the whole grid of orders is solved from one small matrix a series. The innovations of the chosen model
are carried along the series by a linear recursion over its slices, and errors and bands come from these. Lags are windows over
blocks of rows; no series is one task.

The fit is conditional least squares, not exact maximum likelihood.

Fits that aren't stationary are left out, as are seasonal ones that aren't invertible; a moving average without season is replaced by
the invertible one of the same autocovariances.

Defined results: a series of which no order is left has no forecast; a series that is too short for the largest order (fewer than 10 rows more than its lags) has no forecast; rows
without y are not rows of a series (gaps have to be filled before); a constant series is forecast as that constant.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.lineage import remove, settle
from pulseloom.functions.ordered import framed, recursion

KEY = ["series_id"]
#: (p, d, q, P, D, Q) of the search that the reference calls automatic, without season.
GRID = tuple((p, d, q, 0, 0, 0) for d in (0, 1) for p in range(4) for q in range(3))
SEASONAL = tuple((p, d, q, P, D, Q) for D in (0, 1) for d in (0, 1) for p in range(3) for q in range(2) for P in (0, 1) for Q in (0, 1))


def differencing(d: int, big_d: int, period: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D by lag."""
    out = np.ones(1)
    for _ in range(d):
        out = np.convolve(out, [1, -1])
    for _ in range(big_d):
        out = np.convolve(out, np.r_[1, np.zeros(period - 1), -1])
    return out


def _lags(df: DataFrame, column: str, lags: Sequence[int], prefix: str) -> DataFrame:
    """df with the column's value `k` rows earlier for each of the lags."""
    return framed(df, KEY, "i", lambda w: {f"{prefix}{k}": F.lag(column, k).over(w) for k in lags}, max(lags), 0, number="i") if lags else df


def _combined(columns: Sequence[str], weights: Sequence[float]):
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        if w:
            total = total + F.col(c) * float(w)
    return total


def _products(rows: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Per series n, yy and the products of (1, xs) with each other (upper triangle) and with y."""
    d = rows.withColumn("one", F.lit(1.0))
    cols = ["one", *xs]
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    return d.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in cols]).alias("xy"))


def _matrix(triangle: Sequence[float], size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = triangle
    return m + np.triu(m, 1).T


def _long_autoregression(rows: DataFrame, size: int) -> DataFrame:
    """rows with e, the error of a regression of z on its `size` lags z1, z2, ...; from sums of products."""

    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(_matrix(a, size + 1), np.asarray(b, float), rcond=None)[0].tolist() for a, b in zip(xx, xy, strict=True)])

    fit = _products(rows, [f"z{k}" for k in range(1, size + 1)], "z").select(*KEY, solved("xx", "xy").alias("beta"))
    error = F.col("z") - F.col("beta")[0]
    for k in range(1, size + 1):
        error = error - F.col("beta")[k] * F.col(f"z{k}")
    return rows.join(fit, KEY).withColumn("e", error).drop("beta")


def _terms(order: Sequence[int], period: int) -> list[str]:
    p, _, q, big_p, _, big_q = order
    return [*[f"z{k}" for k in range(1, p + 1)], *[f"z{k * period}" for k in range(1, big_p + 1)], *[f"e{k}" for k in range(1, q + 1)], *[f"e{k * period}" for k in range(1, big_q + 1)]]


def _settled(terms: Sequence[str], beta: np.ndarray) -> bool:
    """Whether the fit is stationary and invertible. Roots of a moving average without season that lie inside are turned outside, in beta."""

    def roots(letter: str, sign: float) -> np.ndarray:
        lags = {int(t[1:]): sign * x for t, x in zip(terms, beta[1:], strict=True) if t[0] == letter}
        return np.roots([1.0, *[lags.get(k, 0.0) for k in range(1, max(lags, default=0) + 1)]])

    if (np.abs(roots("z", -1)) >= 1).any():
        return False
    around, own = roots("e", 1), [k for k, t in enumerate(terms, 1) if t[0] == "e"]
    if (np.abs(around) > 1).any():
        if len(around) != len(own):
            return False
        beta[own] = np.poly(np.where(np.abs(around) > 1, 1 / np.conj(around), around))[1:].real
    return True


def _grid(orders: Sequence[Sequence[int]], names: Sequence[str], period: int):
    """A function of n, yy, xx, xy and the mean taken off y before, that fits every order from the products of all the names."""

    @F.pandas_udf("array<struct<order:array<int>,terms:array<string>,beta:array<double>,sse:double,aic:double,bic:double>>")
    def solved(n: pd.Series, yy: pd.Series, xx: pd.Series, xy: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for count, total, a, b, level in zip(n, yy, xx, xy, mean, strict=True):
            m, v, found = _matrix(a, len(names) + 1), np.asarray(b, float), []
            for order in orders:
                terms = _terms(order, period)
                at = [0, *[names.index(t) + 1 for t in terms]]
                beta = np.linalg.lstsq(m[np.ix_(at, at)], v[at], rcond=None)[0]
                sse = max(1e-12, float(total - 2 * beta @ v[at] + beta @ m[np.ix_(at, at)] @ beta))
                if not _settled(terms, beta):
                    continue
                like = count * math.log(sse / count)
                if not order[1] and not order[4]:
                    beta[0] += level * (1 - sum(x for t, x in zip(terms, beta[1:], strict=True) if t[0] == "z"))
                found.append({"order": list(order), "terms": terms, "beta": beta.tolist(), "sse": sse, "aic": like + 2 * (len(at) + 1), "bic": like + math.log(count) * (len(at) + 1)})
            out.append(found)
        return pd.Series(out)

    return solved


def fits(series: DataFrame, orders: Sequence[Sequence[int]] = GRID, period: int = 12, long: int | None = None, trash: list[str] | None = None) -> DataFrame:
    """series_id, order (p, d, q, P, D, Q), terms, beta (the constant first), n, sse, aic, bic: every order of every series, on the same rows."""
    seasonal = any(any(o[3:]) for o in orders)
    if seasonal and any(max(o[0], o[2]) >= period for o in orders):
        raise ValueError("p and q are below the period")
    most = max(max(o[0], o[2]) for o in orders)
    size = long or (period + most + 1 if seasonal else most + 4)
    lost = max(o[1] + o[4] * period for o in orders)
    farthest = max([1, *[max(o[0], o[2], o[3] * period, o[5] * period) for o in orders]])
    start = lost + size + farthest
    out, means = None, series.groupBy(*KEY).agg(F.avg("y").alias("mean"))
    series = settle(series.select(*KEY, "i", "y").join(means, KEY).select(*KEY, "i", (F.col("y") - F.col("mean")).alias("y"), "mean"), trash)
    means = series.groupBy(*KEY).agg(F.max("mean").alias("mean"))
    for d, big_d in sorted({(o[1], o[4]) for o in orders}):
        own = [tuple(o) for o in orders if (o[1], o[4]) == (d, big_d)]
        c = differencing(d, big_d, period)
        used = [k for k in range(1, len(c)) if c[k]]
        z = _lags(series.select(*KEY, "i", "y"), "y", used, "y").withColumn("z", _combined(["y", *[f"y{k}" for k in used]], [1.0, *[c[k] for k in used]])).where(F.col("z").isNotNull()).select(*KEY, "i", "z")
        names = sorted({t for o in own for t in _terms(o, period)})
        back = sorted({*range(1, size + 1), *[int(t[1:]) for t in names if t[0] == "z"]})
        z = _lags(z, "z", back, "z")
        e = _long_autoregression(z.where(F.col(f"z{size}").isNotNull()), size)
        e = settle(e.select(*KEY, "i", "z", "e", *[t for t in names if t[0] == "z"]), trash)
        rows = _lags(e, "e", sorted({int(t[1:]) for t in names if t[0] == "e"}), "e").where(F.col("i") >= start)

        part = _products(rows, names, "z").where("n >= 10").join(means, KEY).select(*KEY, "n", F.explode(_grid(own, names, period)("n", "yy", "xx", "xy", "mean")).alias("fit")).select(*KEY, "n", "fit.*")
        out = part if out is None else out.union(part)
    return out


def _polynomials(order: Sequence[int], terms: Sequence[str], beta: Sequence[float], period: int) -> tuple[np.ndarray, np.ndarray]:
    """a and b of sum a_j y_t-j = constant + e_t + sum b_j e_t-j, a_0 = 1; b from lag 1 on."""
    ar, ma = np.zeros(1 + max([0, *[int(t[1:]) for t in terms if t[0] == "z"]])), np.zeros(max([0, *[int(t[1:]) for t in terms if t[0] == "e"]]))
    ar[0] = 1
    for t, v in zip(terms, beta[1:], strict=True):
        if t[0] == "z":
            ar[int(t[1:])] -= v
        else:
            ma[int(t[1:]) - 1] += v
    return np.convolve(ar, differencing(order[1], order[4], period)), ma


def arima(series: DataFrame, orders: Sequence[Sequence[int]] = GRID, period: int = 12, steps: int = 10, long: int | None = None, trash: list[str] | None = None) -> DataFrame:
    """series_id, i, forecast, low, high (95 %) of the next `steps` steps by the order of least AIC; p, d, q, sp, sd, sq, aic, bic, rmse, mae of it.

    What the result reads is settled under `trash`.
    """
    spark, spent = series.sparkSession, []
    pick = F.min(F.struct("aic", "order", "terms", "beta", "n", "bic"))
    best = fits(series, orders, period, long, spent).groupBy(*KEY).agg(pick.alias("best")).select(*KEY, "best.*")

    @F.pandas_udf("struct<ar:array<double>,ma:array<double>,back:array<double>>")
    def polynomials(order: pd.Series, terms: pd.Series, beta: pd.Series) -> pd.DataFrame:
        both = [_polynomials(o, t, b, period) for o, t, b in zip(order, terms, beta, strict=True)]
        return pd.DataFrame({"ar": [a.tolist() for a, _ in both], "ma": [b.tolist() for _, b in both], "back": [(-b).tolist() for _, b in both]})

    best = settle(best.withColumn("poly", polynomials("order", "terms", "beta")).select(*KEY, "order", "aic", "bic", "n", F.col("beta")[0].alias("constant"), "poly.*"), spent)
    most = max(max(o[0], o[3] * period) + o[1] + o[4] * period for o in orders)

    def before(w):
        return {"ys": F.reverse(F.collect_list("y").over(w.rowsBetween(-most, 0)))}

    rows = framed(series.select(*KEY, "i", F.col("y").cast("double").alias("y")), KEY, "i", before, most, 0, number="i").join(best.select(*KEY, "constant", "ar", "back"), KEY)
    rows = rows.where(F.size("ys") >= F.size("ar")).withColumn("u", F.aggregate(F.zip_with("ar", F.slice("ys", F.lit(1), F.size("ar")), lambda a, y: a * y), -F.col("constant"), lambda s, v: s + v))
    e = settle(recursion(rows.select(*KEY, "i", "y", "u", "back"), KEY, "i", "u", "e", "back").select(*KEY, "i", "y", "e"), spent)
    last = series.groupBy(*KEY).agg(F.max("i").alias("last"))
    fitted = e.join(last, KEY).join(best.select(*KEY, "n"), KEY).where(F.col("i") > F.col("last") - F.col("n")).groupBy(*KEY).agg(F.avg(F.col("e") * F.col("e")).alias("variance"), F.avg(F.abs("e")).alias("mae"))
    keep = max(most, *[max(o[2], o[5] * period) for o in orders], 1)
    tail = lambda df, c: df.join(last, KEY).where(F.col("i") > F.col("last") - keep).groupBy(*KEY).agg(F.max("last").alias("last"), F.transform(F.sort_array(F.collect_list(F.struct("i", c)), asc=False), lambda x: x[c]).alias(f"{c}s"))

    @F.pandas_udf("array<struct<h:int,forecast:double,spread:double>>")
    def ahead(constant: pd.Series, ar: pd.Series, ma: pd.Series, ys: pd.Series, es: pd.Series) -> pd.Series:
        out = []
        for c, a, b, y, e in zip(constant, ar, ma, ys, es, strict=True):
            y, e, psi, found = list(y), list(e), [1.0], []
            for h in range(1, steps + 1):
                value = c - sum(a[j] * y[j - 1] for j in range(1, len(a))) + sum(b[j] * e[j] for j in range(min(len(b), len(e))))
                found.append({"h": h, "forecast": value, "spread": math.sqrt(sum(x * x for x in psi))})
                psi.append((b[h - 1] if h <= len(b) else 0.0) - sum(a[j] * psi[h - j] for j in range(1, min(h, len(a) - 1) + 1)))
                y.insert(0, value)
                e.insert(0, 0.0)
            out.append(found)
        return pd.Series(out)

    told = best.join(fitted, KEY).join(tail(series, "y"), KEY).join(tail(e, "e").drop("last"), KEY)
    told = told.select(*KEY, "order", "aic", "bic", "variance", "mae", "last", F.explode(ahead("constant", "ar", "ma", "ys", "es")).alias("f"))
    half = 1.959964 * F.sqrt("variance") * F.col("f.spread")
    out = settle(told.select(
        *KEY, (F.col("last") + F.col("f.h")).alias("i"), F.col("f.forecast"), (F.col("f.forecast") - half).alias("low"), (F.col("f.forecast") + half).alias("high"),
        *[F.col("order")[k].alias(n) for k, n in enumerate(("p", "d", "q", "sp", "sd", "sq"))], "aic", "bic", F.sqrt("variance").alias("rmse"), "mae",
    ), trash)
    remove(spark, spent)
    return out
