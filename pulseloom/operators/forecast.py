"""Forecasting per series: rows (series_id, i from 0, y). Every series of a table in one job; no series meets another.

ARIMA-like and seasonal models are least squares on lag or Fourier columns: sums of products per series in one
aggregation, and a small solve of those sums per series in Arrow batches. They aren't maximum-likelihood fits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulseloom.functions.ordered import recursion


def by_time() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("i")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def build_series(df: DataFrame, series: str, at: str, value: str, how: str = "mean", least: int = 3) -> DataFrame:
    """series_id, i, y: mean or median of value per step, for series of `least` steps and more."""
    made = F.avg(value) if how == "mean" else F.percentile(value, F.lit(0.5))
    d = df.groupBy(F.col(series).alias("series_id"), F.col(at).alias("at")).agg(made.alias("y")).where("y is not null")
    d = d.withColumns({"i": F.row_number().over(Window.partitionBy("series_id").orderBy("at")) - 1, "n": F.count("*").over(whole())})
    return d.where(F.col("n") >= least).select("series_id", F.col("i").cast("long").alias("i"), "y")


def exponential_smoothing(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """smooth for every step: alpha y + (1 - alpha) of the one before, from the first y on; a linear recursion over slices of the series."""
    d = series.select("series_id", "i", "y").join(series.groupBy("series_id").agg(F.min("i").alias("first_")), "series_id")
    d = d.withColumn("drive_", F.when(F.col("i") == F.col("first_"), F.col("y")).otherwise(alpha * F.col("y")))
    return recursion(d.drop("first_"), ["series_id"], "i", "drive_", "smooth", [1 - alpha]).select("series_id", "i", "y", "smooth")


def smoothing_forecast(series: DataFrame, alpha: float = 0.3, most: int = 5) -> DataFrame:
    """A flat forecast of min(n / 2, most) steps with 10 % on both sides, and the fit's RMSE and MAE."""
    s = exponential_smoothing(series, alpha)
    e = F.col("y") - F.col("smooth")
    s = s.groupBy("series_id").agg(F.count("*").alias("n"), F.max_by("smooth", "i").alias("forecast"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    steps = F.least(F.floor(F.col("n") / 2), F.lit(most)).cast("int")
    s = s.where(steps >= 1).withColumn("h", F.explode(F.sequence(F.lit(1), steps)))
    return s.select("series_id", (F.col("n") - 1 + F.col("h")).alias("i"), "forecast", (F.col("forecast") - 0.1 * F.abs("forecast")).alias("low"), (F.col("forecast") + 0.1 * F.abs("forecast")).alias("high"), "rmse", "mae")


def adaptation(series: DataFrame) -> DataFrame:
    """trend, slope, rate, phase and r2 per series."""
    n = F.count("*").over(whole())
    d = series.withColumns({"n": n, "half": F.floor(n / 2)})
    s = d.groupBy("series_id").agg(
        F.max("n").alias("n"), F.regr_slope("y", "i").alias("slope"), F.stddev_pop("y").alias("sd"), F.regr_r2("y", "i").alias("r2"),
        F.avg(F.when(F.col("i") < F.col("half"), F.col("y"))).alias("first"), F.avg(F.when(F.col("i") >= F.col("half"), F.col("y"))).alias("second"),
    )
    trend = F.when(F.abs("slope") < 0.01 * F.col("sd"), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    change = F.abs(F.col("second") - F.col("first")) / F.col("first")
    s = s.withColumn("trend", trend)
    phase = F.when(F.col("n") < 4, "insufficient_data").when(change < 0.1, "adapted").when(F.col("trend") == "stable", "stabilizing").otherwise("adapting")
    return s.select("series_id", "trend", "slope", F.abs("slope").alias("rate"), phase.alias("phase"), "r2")


def adaptation_summary(each: DataFrame) -> DataFrame:
    """Series per (trend, phase) and their mean rate."""
    return each.groupBy("trend", "phase").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"))


def future_class(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """relative_change of the mean forecast against the last three values, and its class."""
    last = series.withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("i")))).where("back <= 3").groupBy("series_id").agg(F.avg("y").alias("recent"))
    d = forecast.groupBy("series_id").agg(F.avg("forecast").alias("mean_forecast")).join(last, "series_id").withColumn("relative_change", (F.col("mean_forecast") - F.col("recent")) / F.col("recent"))
    c = F.col("relative_change")
    return d.select("series_id", "relative_change", F.when(F.abs(c) < 0.05, "stable_adaptation").when(c > 0.1, "positive_adaptation").when(c < -0.1, "negative_adaptation").otherwise("mild_change").alias("outlook"))


def trend_strength(series: DataFrame) -> DataFrame:
    """Share of variance that the centred rolling mean over max(3, n / 10) steps keeps; series of 8 and more."""
    d = series.withColumns({"n": F.count("*").over(whole()), "w": F.greatest(F.lit(3), F.floor(F.count("*").over(whole()) / 10)).cast("int")}).where("n >= 8")
    near = d.select("series_id", F.explode(F.sequence(F.col("i") - F.col("w") + 1 + F.floor(F.col("w") / 2), F.col("i") + F.floor(F.col("w") / 2))).alias("i"), F.col("y").alias("x"))
    m = near.groupBy("series_id", "i").agg(F.avg("x").alias("m"))
    j = d.join(m, ["series_id", "i"]).groupBy("series_id").agg(F.var_pop("m").alias("vm"), F.var_pop("y").alias("vy"), F.regr_slope("y", "i").alias("slope"))
    return j.select("series_id", (F.col("vm") / (F.col("vy") + 1e-12)).alias("strength"), F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable").alias("direction"))


def adf(series: DataFrame) -> DataFrame:
    """t of y's level in dy = a + b y + c dy_before, by normal equations as sums; below -2.86 at 5 % means stationary."""
    dy = F.col("y") - F.lag("y").over(by_time())
    d = series.withColumn("dy", dy).withColumns({"x": F.lag("y").over(by_time()), "z": F.lag("dy").over(by_time())}).where("z is not null")
    s = d.groupBy("series_id").agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(f"{a}_{b}") for a, b in (("x", "x"), ("z", "z"), ("x", "z"), ("x", "dy"), ("z", "dy"), ("dy", "dy"))])
    det = F.col("x_x") * F.col("z_z") - F.col("x_z") * F.col("x_z")
    b, c = (F.col("x_dy") * F.col("z_z") - F.col("z_dy") * F.col("x_z")) / det, (F.col("z_dy") * F.col("x_x") - F.col("x_dy") * F.col("x_z")) / det
    s = s.withColumns({"b": b, "rest": (F.col("dy_dy") - b * F.col("x_dy") - c * F.col("z_dy")) * (F.col("n") - 1) / (F.col("n") - 3), "inv": F.col("z_z") / det / (F.col("n") - 1)})
    s = s.withColumn("adf", F.col("b") / F.sqrt(F.col("rest") * F.col("inv")))
    return s.select("series_id", "adf", (F.col("adf") < -2.86).alias("adf_stationary"))


def kpss(series: DataFrame) -> DataFrame:
    """Sum of squared partial sums over n^2 times the long-run variance, without lags; over 0.463 at 5 % means not stationary."""
    d = series.withColumn("e", F.col("y") - F.avg("y").over(whole()))
    d = d.withColumn("s", F.sum("e").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    s = d.groupBy("series_id").agg((F.sum(F.col("s") * F.col("s")) / (F.count("*") * F.sum(F.col("e") * F.col("e")))).alias("kpss"))
    return s.withColumn("kpss_stationary", F.col("kpss") < 0.463)


def residual_diagnostics(series: DataFrame, lags: int = 10) -> DataFrame:
    """Of residuals (series_id, i, y): mean, sd, skew, kurtosis, Jarque-Bera and Ljung-Box."""
    from pulseloom.operators.timeagg import autocorrelation

    acf = autocorrelation(series, ["series_id"], "y", "i", lags).where("lag > 0")
    m = series.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.skewness("y").alias("skew"), F.kurtosis("y").alias("kurtosis"))
    q = acf.join(m.select("series_id", "n"), "series_id").groupBy("series_id").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")) * F.col("n") * (F.col("n") + 2)).alias("ljung_box"))
    return m.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4)).join(q, "series_id")


def accuracy(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE of (series_id, i, forecast) against (series_id, i, y)."""
    e = F.col("y") - F.col("forecast")
    d = actual.select("series_id", "i", "y").join(forecast.select("series_id", "i", "forecast"), ["series_id", "i"])
    return d.groupBy("series_id").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.abs(e / F.when(F.col("y") == 0, 1.0).otherwise(F.col("y"))))).alias("mape"))


def holdout(series: DataFrame, test: int = 5) -> DataFrame:
    """Accuracy of flat smoothing on each series' last `test` steps."""
    d = series.withColumn("n", F.count("*").over(whole()))
    train, rest = d.where(F.col("i") < F.col("n") - test).drop("n"), d.where(F.col("i") >= F.col("n") - test).drop("n")
    level = exponential_smoothing(train).groupBy("series_id").agg(F.max_by("smooth", "i").alias("forecast"))
    return accuracy(rest, rest.select("series_id", "i").join(level, "series_id"))


def _solve(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Least squares of y on columns (and 1) per key, from sums of products: beta, n, sse."""
    xs = ["one", *columns]
    pairs = [(a, b) for k, a in enumerate(xs) for b in xs[k:]]
    d = rows.withColumn("one", F.lit(1.0))
    sums = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("y")) for a in xs]).alias("xy")
    )
    size = len(xs)

    @F.pandas_udf("struct<beta:array<double>,sse:double>")
    def solved(xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(xx, xy, yy, strict=True):
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = a
            m = m + np.triu(m, 1).T
            beta = np.linalg.lstsq(m, np.asarray(b, float), rcond=None)[0]
            out.append((beta.tolist(), max(0.0, float(c - beta @ np.asarray(b, float)))))
        return pd.DataFrame(out, columns=["beta", "sse"])

    return sums.withColumn("fit", solved("xx", "xy", "yy")).select(*keys, "n", F.col("fit.beta").alias("beta"), F.col("fit.sse").alias("sse"))


def autoregression(series: DataFrame, orders: Sequence[tuple[int, int]] = ((1, 0), (2, 0), (3, 0), (1, 1), (2, 1))) -> DataFrame:
    """Per series the order (p, d) of least AIC by conditional least squares, and the one-step forecast with a 95 % band."""
    top = max(p + d for p, d in orders)
    fits = None
    for p, d in orders:
        x = series
        for _ in range(d):
            x = x.withColumn("y", F.col("y") - F.lag("y").over(by_time()))
        x = x.withColumns({f"l{k}": F.lag("y", k).over(by_time()) for k in range(1, p + 1)}).where(F.col("i") >= top)
        fit = _solve(x, [f"l{k}" for k in range(1, p + 1)])
        n = F.col("n")
        last = x.withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("i")))).where("back = 1")
        now = [F.col("y"), *[F.col(f"l{k}") for k in range(1, p)]]
        step = F.element_at("beta", 1)
        for k, c in enumerate(now):
            step = step + F.element_at("beta", k + 2) * c
        level = series.groupBy("series_id").agg(F.max_by("y", "i").alias("level"), (F.max("i") + 1).alias("next"))
        fit = fit.join(last, "series_id").join(level, "series_id").select(
            "series_id", F.lit(p).alias("p"), F.lit(d).alias("d"), (n * F.log(F.greatest(F.col("sse"), F.lit(1e-12)) / n) + 2 * (p + 2)).alias("aic"), F.sqrt(F.col("sse") / n).alias("rmse"),
            F.col("next").alias("i"), (step + (F.col("level") if d else F.lit(0.0))).alias("forecast"),
        )
        fits = fit if fits is None else fits.union(fit)
    best = fits.withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy("aic", "p", "d"))).where("k = 1").drop("k")
    return best.withColumns({"low": F.col("forecast") - 1.959964 * F.col("rmse"), "high": F.col("forecast") + 1.959964 * F.col("rmse")})


def _waves(at: Column, period: float, terms: int) -> dict[str, Column]:
    angle = lambda k: F.lit(2 * math.pi * k / period) * at
    return {f"s{k}": F.sin(angle(k)) for k in range(1, terms + 1)} | {f"c{k}": F.cos(angle(k)) for k in range(1, terms + 1)}


def seasonal_regression(series: DataFrame, period: float = 12, terms: int = 2, steps: int = 6) -> DataFrame:
    """Line, hinge at the middle and Fourier terms: a forecast of `steps` with a 95 % band."""
    d = series.withColumns({"t": F.col("i").cast("double"), "hinge": F.greatest(F.lit(0.0), F.col("i") - F.count("*").over(whole()) / 2), **_waves(F.col("i"), period, terms)})
    names = ["t", "hinge", *_waves(F.col("i"), period, terms)]
    fit = _solve(d, names).join(series.groupBy("series_id").agg(F.max("i").alias("last")), "series_id")
    f = fit.withColumn("i", F.explode(F.sequence(F.col("last") + 1, F.col("last") + steps)))
    f = f.withColumns({"t": F.col("i").cast("double"), "hinge": F.greatest(F.lit(0.0), F.col("i") - (F.col("last") + 1) / 2), **_waves(F.col("i"), period, terms)})
    y = F.element_at("beta", 1)
    for k, c in enumerate(names):
        y = y + F.element_at("beta", k + 2) * F.col(c)
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    return f.select("series_id", "i", y.alias("forecast"), (y - 1.959964 * rmse).alias("low"), (y + 1.959964 * rmse).alias("high"), rmse.alias("rmse"))


def compare(models: dict[str, DataFrame]) -> DataFrame:
    """Models per series by RMSE, the best first, from tables (series_id, rmse)."""
    out = None
    for name, m in models.items():
        part = m.groupBy("series_id").agg(F.min("rmse").alias("rmse")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("rmse", "model")))


def ensemble(forecasts: Sequence[DataFrame]) -> DataFrame:
    """The mean of all forecasts of a step."""
    out = forecasts[0].select("series_id", "i", "forecast")
    for f in forecasts[1:]:
        out = out.unionByName(f.select("series_id", "i", "forecast"))
    return out.groupBy("series_id", "i").agg(F.avg("forecast").alias("forecast"), F.count("*").alias("n_models"))


def pooled(series: DataFrame) -> DataFrame:
    """The mean over series at each step, smoothed, and each series' offset from it."""
    mean = series.groupBy("i").agg(F.avg("y").alias("pool"))
    offset = series.join(mean, "i").groupBy("series_id").agg(F.avg(F.col("y") - F.col("pool")).alias("offset"))
    level = exponential_smoothing(mean.select(F.lit("pool").alias("series_id"), "i", F.col("pool").alias("y"))).agg(F.max_by("smooth", "i").alias("level"))
    return offset.join(F.broadcast(level)).select("series_id", "offset", (F.col("level") + F.col("offset")).alias("forecast"))  # level is one row
