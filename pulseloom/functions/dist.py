"""Distribution functions on small result tables: Arrow-batched UDFs over numpy; no raw rows ever pass here."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _each(f, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel()], float).reshape(x.shape)


def _gammaln(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erf(x) -> np.ndarray:
    return _each(math.erf, x)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    front = np.exp(_gammaln(p + q) - _gammaln(p) - _gammaln(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.maximum(1 - (p + q) * z / (p + 1), tiny)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    got = np.where(inside, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.clip(np.where(swap, 1 - got, got), 0, 1)


def gamma_inc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    z = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(z) - z - _gammaln(a))
    term = total = 1 / a
    for n in range(1, 500):
        term = term * z / (a + n)
        total = total + term
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for n in range(1, 500):
        top = -n * (n - a)
        b = b + 2
        d = top * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + top / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.clip(np.where(z < a + 1, front * total, 1 - front * h), 0, 1))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_reach(level: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The t with `level` between -t and t, by bisection of the distribution function."""
    level, df = np.broadcast_arrays(np.asarray(level, float), np.asarray(df, float))
    lo, hi = np.zeros(len(df)), np.ones(len(df))
    for _ in range(100):
        hi = np.where(t_two_sided(hi, df) > 1 - level, 2 * hi, hi)
    for _ in range(100):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) > 1 - level
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return 1 - gamma_inc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_quantile(p: float) -> float:
    """By bisection of the distribution function."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(t.isna() | ~(df > 0), np.nan, t_two_sided(t.fillna(0), df.where(df > 0, 1.0))))


@F.pandas_udf(DoubleType())
def _reach(level: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(df > 0, t_reach(level, df.where(df > 0, 1.0)), np.nan))


@F.pandas_udf(DoubleType())
def _f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(np.where(f.isna() | ~(d1 > 0) | ~(d2 > 0), np.nan, f_upper(f.fillna(0), d1.where(d1 > 0, 1.0), d2.where(d2 > 0, 1.0))))


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.where(x.isna(), np.nan, chi2_upper(x.fillna(0), df.fillna(1))))


@F.pandas_udf(DoubleType())
def _z(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), np.nan, 2 * (1 - normal_cdf(z.abs().fillna(0)))))


def p_t(t: Column, df: Column) -> Column:
    return _t(t.cast("double"), df.cast("double"))


def q_t(level: Column, df: Column) -> Column:
    """The t that a two-sided interval of that level reaches to."""
    return _reach(level.cast("double"), df.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _f(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    return _chi2(x.cast("double"), df.cast("double"))


def p_z(z: Column) -> Column:
    return _z(z.cast("double"))
