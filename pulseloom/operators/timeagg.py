"""Time buckets, phases, rolling windows, distributions and reference ranges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulseloom.functions.columns import median
from pulseloom.functions.ordered import FRAME_ROWS, beside, framed, running
from pulseloom.operators.models import normal_score


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """date, hour, minute, day_name, is_night (19 to 7) and recording_day (1 for the first date)."""
    t = F.col(ts)
    d = df.withColumns({"date": F.to_date(t), "hour": F.hour(t), "minute": F.minute(t), "day_name": F.date_format(t, "EEEE")})
    d = d.withColumn("is_night", (F.col("hour") >= 19) | (F.col("hour") < 7))
    days = d.select("date").distinct().withColumn("recording_day", F.dense_rank().over(Window.orderBy("date")))  # one row per date
    return d.join(days, "date")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, median, min, max, q1, q3 per group."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), q(0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def bucket_means(df: DataFrame, keys: Sequence[str], width: str, value: str = "hr", ts: str = "ts") -> DataFrame:
    """Mean and count per time bucket; buckets without rows don't appear."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    out = df.groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("start"), "mean", "n")


def hour_stats(df: DataFrame, keys: Sequence[str], value: str = "hr", ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("start")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))


def phases_by_range(df: DataFrame, at: str = "sol") -> DataFrame:
    """phase: early, mid or late by equal thirds of the range."""
    s = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / 3
    phase = F.when(F.col(at) <= F.col("lo") + step, "early").when(F.col(at) <= F.col("lo") + 2 * step, "mid").otherwise("late")
    return df.join(F.broadcast(s)).withColumn("phase", phase).drop("lo", "hi")  # s is one row


def phases_by_quantile(df: DataFrame, at: str = "sol") -> DataFrame:
    """phase by the quantiles 0.33 and 0.67; by thirds of the distinct values in order where a phase would be empty."""
    s = df.agg(F.percentile(at, F.lit(0.33)).alias("a"), F.percentile(at, F.lit(0.67)).alias("b"))
    d = df.join(F.broadcast(s)).withColumn("phase", F.when(F.col(at) <= F.col("a"), "early").when(F.col(at) <= F.col("b"), "mid").otherwise("late")).drop("a", "b")
    if d.select("phase").distinct().count() == 3:  # 3 rows at most
        return d
    values = df.groupBy(at).count()
    order = Window.orderBy(at)
    place = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("count").over(Window.partitionBy())
    place = F.coalesce(place, F.lit(0.0))
    thirds = values.select(F.col(at).alias("v"), F.when(place < 1 / 3, "early").when(place < 2 / 3, "mid").otherwise("late").alias("phase"))
    return df.join(thirds, df[at].eqNullSafe(F.col("v"))).drop("v")


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, size: int, least: int = 1) -> DataFrame:
    """Centred mean over `size` rows (even windows reach one row further back), null below `least` rows."""
    back, ahead = size // 2, size - 1 - size // 2

    def columns(over: WindowSpec) -> dict[str, Column]:
        w = over.rowsBetween(-back, ahead)
        return {"rolling": F.when(F.count(value).over(w) >= least, F.avg(value).over(w))}

    return framed(df, keys, order, columns, back, ahead)


def variability_band(df: DataFrame, keys: Sequence[str], order: str, value: str, size: int) -> DataFrame:
    """Centred mean with one deviation on both sides; null until the window is full."""
    back, ahead = size // 2, size - 1 - size // 2

    def columns(over: WindowSpec) -> dict[str, Column]:
        w = over.rowsBetween(-back, ahead)
        full = F.count(value).over(w) == size
        m, s = F.avg(value).over(w), F.stddev_samp(value).over(w)
        return {"mid": F.when(full, m), "lower": F.when(full, m - s), "upper": F.when(full, m + s)}

    return framed(df, keys, order, columns, back, ahead)


def box_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number outside."""
    s = describe(df, keys, value).select(*keys, "n", "q1", "median", "q3")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    d = df.join(s, list(keys)).withColumn("inside", F.col(value).between(F.col("q1") - fence, F.col("q3") + fence))
    w = d.groupBy(*keys).agg(F.min(F.when(F.col("inside"), F.col(value))).alias("low"), F.max(F.when(F.col("inside"), F.col(value))).alias("high"), F.count_if(~F.col("inside")).alias("n_outside"))
    return s.join(w, list(keys))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """bin (0-based), its lower edge and count; the greatest value falls into the last bin."""
    s = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    d = df.join(s, list(keys)).where(F.col(value).isNotNull()).withColumns({"bin": at, "left": F.col("lo") + at * width})
    return d.groupBy(*keys, "bin", "left").agg(F.count("*").alias("n"))


def rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """dt and rate: the time since the group's previous row, by the first column of `order`, and the change per unit of it; rows without one are left out."""
    d = beside(df, keys, order, {"t_": order[0], "v_": value}, -1).withColumn("dt", F.col(order[0]) - F.col("t_")).where("dt > 0")
    return d.withColumn("rate", (F.col(value) - F.col("v_")) / F.col("dt")).drop("t_", "v_")


def quantile_plot(df: DataFrame, keys: Sequence[str], value: str, points: int = 200) -> DataFrame:
    """k, theoretical, value: at most `points` values of each group in even steps of rank, the first and the last among them, beside the normal
    quantile of (rank - 0.5) / n. Equal values take their places one after the other."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    c = running(c, keys, value, {"ahead": F.col("c")}, totals=True).withColumnRenamed("total_ahead", "n")
    steps = F.least(F.col("n"), F.lit(points))
    # Point k of `steps` stands for rank floor(k (n - 1) / (steps - 1)) + 1: the points whose ranks lie within a value's run of c.
    rank = lambda k: F.when(steps > 1, F.floor(k * (F.col("n") - 1) / (steps - 1))).otherwise(F.lit(0)) + 1
    first = F.ceil(F.col("ahead") * (steps - 1) / F.greatest(F.col("n") - 1, F.lit(1))) - 1
    last = F.ceil((F.col("ahead") + F.col("c")) * (steps - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    near = F.sequence(F.greatest(first, F.lit(0)), F.least(last, steps - 1))
    d = c.withColumn("k", F.explode(near)).withColumn("rank", rank(F.col("k"))).where("rank > ahead and rank <= ahead + c")
    return d.select(*keys, F.col("k").cast("int").alias("k"), normal_score((F.col("rank") - 0.5) / F.col("n")).alias("theoretical"), value)


def pivot(df: DataFrame, by: Sequence[str], column: str, value: str, names: Sequence[str] | None = None, most: int = 1000) -> DataFrame:
    """Means of value, a row per `by` and a column per value of `column`: those in names, else all that occur, which may be `most` at the most."""
    if names is None:
        names = sorted(r[0] for r in df.select(F.col(column).cast("string")).distinct().where(F.col(column).isNotNull()).limit(most + 1).collect())
        if len(names) > most:
            raise ValueError(f"over {most} columns")
    return df.groupBy(*by).pivot(column, list(names)).agg(F.avg(value))


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str = "x", at: str = "i", lags: int = 40, rows: int = FRAME_ROWS) -> DataFrame:
    """lag, acf from 0 to `lags` for series numbered by `at`: products within blocks of `rows` numbers that also get the `lags` rows before
    them, summed over the blocks. No join; a series is as many tasks as it has blocks."""
    size = max(rows, lags + 1)
    block = lambda shift: F.floor((F.col(at) + shift) / size)
    d = df.select(*keys, F.col(at).cast("long").alias(at), (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))).cast("double").alias("c"))
    d = d.withColumn("block_", F.explode(F.array_distinct(F.array(block(0), block(lags)))))

    def products(t: pa.Table) -> pa.Table:
        place = t[at].to_numpy() - t["block_"][0].as_py() * size + lags
        c, there, known = np.zeros(size + lags), np.zeros(size + lags, bool), np.zeros(size + lags, bool)
        valid = ~t["c"].is_null().to_numpy()
        there[place], known[place[valid]], c[place[valid]] = True, True, t["c"].drop_null().to_numpy()
        lag, s = [], []
        for k in range(lags + 1):
            before = slice(lags - k, lags - k + size)
            if (there[lags:] & there[before]).any():
                both = known[lags:] & known[before]
                lag.append(k)
                s.append(float((c[lags:] * c[before])[both].sum()) if both.any() else None)
        group = t.select(list(keys)).take(pa.array([0] * len(lag), pa.int64()))
        return group.append_column("lag", pa.array(lag, pa.int32())).append_column("s", pa.array(s, pa.float64()))

    kinds = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys])
    sums = d.groupBy(*keys, "block_").applyInArrow(products, f"{kinds}, lag int, s double").groupBy(*keys, "lag").agg(F.sum("s").alias("s"))
    total = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(*keys))  # lags + 1 rows a group
    return sums.select(*keys, "lag", F.try_divide("s", total).alias("acf"))


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """lag, pacf from a table of acf rows by the Durbin-Levinson recursion, on arrays of at most a few dozen values."""
    rows = acf.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    start = F.struct(F.array(F.lit(1.0)).alias("out"), F.array().cast("array<double>").alias("phi"))

    def step(a, k):
        up = F.aggregate(F.sequence(F.lit(1), F.size(a["phi"])), F.lit(0.0), lambda s, j: s + F.get(a["phi"], j - 1) * F.get(F.col("r"), k - j))
        down = F.aggregate(F.sequence(F.lit(1), F.size(a["phi"])), F.lit(0.0), lambda s, j: s + F.get(a["phi"], j - 1) * F.get(F.col("r"), j))
        none = F.size(a["phi"]) == 0
        own = F.when(none, F.get(F.col("r"), k)).otherwise((F.get(F.col("r"), k) - up) / (1 - down))
        moved = F.when(none, F.array().cast("array<double>")).otherwise(F.transform(a["phi"], lambda p, j: p - own * F.get(a["phi"], F.size(a["phi"]) - 1 - j)))
        return F.struct(F.concat(a["out"], F.array(own)).alias("out"), F.concat(moved, F.array(own)).alias("phi"))

    got = F.aggregate(F.sequence(F.lit(1), F.size("r") - 1), start, step)["out"]
    return rows.select(*keys, F.posexplode(got).alias("lag", "pacf"))


# Reference ranges, metric: 5th, 25th, 75th and 95th percentile of healthy people.
REFERENCE = {
    "sdnn": (25.0, 35.0, 50.0, 65.0),
    "sdnn_24h": (90.0, 118.0, 152.0, 180.0),
    "rmssd": (20.0, 28.0, 48.0, 65.0),
    "rmssd_24h": (18.0, 28.0, 52.0, 70.0),
    "pnn50": (3.0, 10.0, 26.0, 38.0),
    "pnn50_24h": (5.0, 14.0, 30.0, 42.0),
    "hf_power": (100.0, 250.0, 900.0, 2500.0),
    "lf_power": (150.0, 350.0, 1100.0, 2800.0),
    "vlf_power": (100.0, 400.0, 1600.0, 4500.0),
    "lf_hf_ratio": (0.3, 1.0, 2.8, 5.0),
    "total_power": (500.0, 1200.0, 3800.0, 8000.0),
    "sd1": (8.0, 12.0, 26.0, 42.0),
    "sd2": (20.0, 32.0, 58.0, 86.0),
    "sd1_sd2_ratio": (0.15, 0.35, 0.52, 0.70),
    "sample_entropy": (0.8, 1.15, 1.65, 2.1),
    "dfa_alpha1": (0.75, 0.90, 1.10, 1.25),
    "stress_index": (3.0, 8.0, 18.0, 30.0),
    "triangular_index": (12.0, 20.0, 35.0, 50.0),
}
# Risk below these.
HIGH_RISK = {"sdnn": 20.0, "sdnn_24h": 70.0, "rmssd": 15.0, "pnn50": 3.0, "hf_power": 100.0, "vlf_power": 50.0, "triangular_index": 15.0}


def assess(long: DataFrame, suffix: str | None = None) -> DataFrame:
    """status, within_normal and at_risk for rows of (metric, value), against the range of the metric or of metric_suffix."""
    spark = long.sparkSession
    rows = [(k, *v, HIGH_RISK.get(k)) for k, v in REFERENCE.items()]
    ranges = F.broadcast(spark.createDataFrame(rows, "ref string, p5 double, p25 double, p75 double, p95 double, risk double"))
    key = F.concat(F.col("metric"), F.lit(f"_{suffix}")) if suffix else F.col("metric")
    status = (
        F.when(F.col("p5").isNull(), "unknown").when(F.col("value") < F.col("p5"), "very_low").when(F.col("value") < F.col("p25"), "low")
        .when(F.col("value") <= F.col("p75"), "normal").when(F.col("value") <= F.col("p95"), "high").otherwise("very_high")
    )
    out = long.join(ranges, F.col("ref") == key, "left").withColumn("status", status)
    return out.withColumns({"within_normal": F.col("status") == "normal", "at_risk": F.coalesce(F.col("value") < F.col("risk"), F.lit(False))}).drop("ref", "p5", "p25", "p75", "p95", "risk")


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def completeness(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Percent of rows that have each metric, per group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[(100 * F.count(m) / F.count("*")).alias(f"{m}_percent") for m in metrics])


def crew_median(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(median(value).alias("median"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.count(value).alias("n"))


def night(hour: Column) -> Column:
    return (hour >= 19) | (hour < 7)
