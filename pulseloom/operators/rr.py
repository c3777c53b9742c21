"""RR intervals from heart rate, artifacts, smoothing, quality. Beats: subject, sol, i (1-based, after filtering), rr in ms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import SEGMENT, clip01, median, ratio

SHORT, LONG = 300.0, 2000.0


def compute_rr(samples: DataFrame, keys: Sequence[str] = SEGMENT, low: float = SHORT, high: float = LONG) -> DataFrame:
    """rr = 60000 / hr within [low, high], numbered in order of time."""
    rr = samples.where("hr > 0").withColumn("rr", F.lit(60000.0) / F.col("hr")).where(F.col("rr").between(low, high))
    return rr.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("t", "seq")).alias("i"), "rr")


def conversion_info(samples: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Samples in, valid, filtered; mean, deviation and range of the heart rates that give valid intervals."""
    hr = F.when((F.col("hr") > 0) & (F.lit(60000.0) / F.col("hr")).between(SHORT, LONG), F.col("hr"))
    out = samples.groupBy(*keys).agg(F.count("*").alias("n_in"), F.count(hr).alias("n_valid"), F.avg(hr).alias("mean_hr"), F.stddev_samp(hr).alias("std_hr"), F.min(hr).alias("min_hr"), F.max(hr).alias("max_hr"))
    return out.withColumn("n_filtered", F.col("n_in") - F.col("n_valid"))


def _neighbours(rr: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column, Column, Column]:
    w = Window.partitionBy(*keys).orderBy("i")
    d = rr.withColumns({"before": F.lag("rr").over(w), "after": F.lead("rr").over(w), "n": F.count("*").over(Window.partitionBy(*keys))})
    return d, F.col("rr"), F.col("before"), F.col("after")


def malik(rr: DataFrame, keys: Sequence[str] = SEGMENT, share: float = 0.2) -> DataFrame:
    """artifact: more than a fifth off both neighbours; never the ends, nor in segments below 10 beats."""
    d, x, p, q = _neighbours(rr, keys)
    off = (F.abs(x - p) / p > share) & (F.abs(x - q) / q > share)
    return d.withColumn("artifact", F.coalesce(off & (F.col("n") >= 10), F.lit(False))).drop("before", "after", "n")


def karlsson(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """artifact: off the median of five around it by more than 15 % of it and three MAD."""
    w = Window.partitionBy(*keys).orderBy("i")
    d = rr.withColumns({"five": F.collect_list("rr").over(w.rowsBetween(-2, 2)), "n": F.count("*").over(Window.partitionBy(*keys))})
    d = d.withColumn("med", F.get(F.array_sort("five"), F.lit(2)))
    mad = F.get(F.array_sort(F.transform("five", lambda x: F.abs(x - F.col("med")))), F.lit(2))
    off = (F.size("five") == 5) & (F.col("n") >= 10) & (F.abs(F.col("rr") - F.col("med")) > F.greatest(0.15 * F.col("med"), 3 * mad))
    return d.withColumn("artifact", F.when(F.size("five") == 5, off).otherwise(False)).drop("five", "med", "n")


def kamath(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """artifact: over 200 ms and over a quarter off the beat before."""
    d, x, p, _ = _neighbours(rr, keys)
    off = (F.abs(x - p) > 200) & (F.abs(x - p) / p > 0.25)
    return d.withColumn("artifact", F.coalesce(off & (F.col("n") >= 10), F.lit(False))).drop("before", "after", "n")


def iqr(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """artifact: outside 1.5 interquartile ranges."""
    w = Window.partitionBy(*keys)
    d = rr.withColumns({"q1": F.percentile("rr", F.lit(0.25)).over(w), "q3": F.percentile("rr", F.lit(0.75)).over(w), "n": F.count("*").over(w)})
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    off = (F.col("n") >= 10) & ((F.col("rr") < F.col("q1") - fence) | (F.col("rr") > F.col("q3") + fence))
    return d.withColumn("artifact", off).drop("q1", "q3", "n")


def zscore(rr: DataFrame, keys: Sequence[str] = SEGMENT, most: float = 3.0) -> DataFrame:
    """artifact: over three population deviations off the mean."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop("rr").over(w)
    off = (F.count("*").over(w) >= 10) & F.when(sd > 0, F.abs(F.col("rr") - F.avg("rr").over(w)) / sd > most).otherwise(False)
    return rr.withColumn("artifact", off)


#: acar has no detector of its own and goes by malik.
DETECTORS: dict[str, Callable[..., DataFrame]] = {"malik": malik, "karlsson": karlsson, "kamath": kamath, "iqr": iqr, "zscore": zscore, "acar": malik}


def clean_rr(rr: DataFrame, method: str = "malik", keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Beats without artifacts, numbered anew."""
    kept = DETECTORS[method](rr, keys).where(~F.col("artifact"))
    return kept.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("i"))).drop("artifact")


def artifact_ratio(flagged: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    out = flagged.groupBy(*keys).agg(F.count("*").alias("n_beats"), F.count_if("artifact").alias("n_artifacts"))
    return out.withColumn("artifact_ratio", F.col("n_artifacts") / F.col("n_beats"))


def resample(rr: DataFrame, keys: Sequence[str] = SEGMENT, hz: float = 4.0, how: str = "linear", centre: bool = False) -> DataFrame:
    """The series on a regular grid: g (grid index), x. Linear, or `cubic` as a local Hermite curve through four beats.

    Beats stand at the sum of all before them, in seconds, the last one dropped; with `centre`, at the middle of their
    own interval, all of them, and the line through the first and last two goes on to 0 and to the end.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    until = F.sum("rr").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 1000
    d = rr.withColumns({"t": until - F.col("rr") / (2000 if centre else 1000), "last": F.sum("rr").over(Window.partitionBy(*keys)) / 1000, "n": F.count("*").over(Window.partitionBy(*keys))})
    if not centre:
        d = d.where("i < n").withColumn("n", F.col("n") - 1)
    d = d.withColumns({"t2": F.lead("t").over(w), "x2": F.lead("rr").over(w), "x0": F.lag("rr").over(w), "t0": F.lag("t").over(w), "x3": F.lead("rr", 2).over(w), "t3": F.lead("t", 2).over(w)}).where("t2 is not null")
    if centre:
        low = F.when(F.col("i") == 1, F.lit(0)).otherwise(F.ceil(F.col("t") * hz))
        high = F.when(F.col("i") == F.col("n") - 1, F.ceil(F.col("last") * hz) - 1).otherwise(F.ceil(F.col("t2") * hz) - 1)
    else:
        low, high = F.ceil(F.col("t") * hz), F.when(F.col("i") == F.col("n") - 1, F.floor(F.col("t2") * hz)).otherwise(F.ceil(F.col("t2") * hz) - 1)
    d = d.withColumns({"low": low.cast("long"), "high": high.cast("long")}).where("low <= high").withColumn("g", F.explode(F.sequence("low", "high")))
    u = (F.col("g") / hz - F.col("t")) / (F.col("t2") - F.col("t"))
    x = F.col("rr") + u * (F.col("x2") - F.col("rr"))
    if how == "cubic":
        h = F.col("t2") - F.col("t")
        m1 = F.coalesce((F.col("x2") - F.col("x0")) / (F.col("t2") - F.col("t0")), (F.col("x2") - F.col("rr")) / h) * h
        m2 = F.coalesce((F.col("x3") - F.col("rr")) / (F.col("t3") - F.col("t")), (F.col("x2") - F.col("rr")) / h) * h
        x = (2 * u**3 - 3 * u**2 + 1) * F.col("rr") + (u**3 - 2 * u**2 + u) * m1 + (3 * u**2 - 2 * u**3) * F.col("x2") + (u**3 - u**2) * m2
    elif how != "linear":
        raise ValueError(f"how is linear or cubic, not {how}")
    return d.select(*keys, F.col("g").cast("long").alias("g"), x.alias("x"))


def savitzky_golay_weights(window: int, order: int) -> list[float]:
    """Weights of the middle value of a least-squares polynomial over an odd window."""
    import numpy as np

    at = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(at, order + 1, increasing=True))[0].tolist()


def lowpass_weights(window: int) -> list[float]:
    """Windowed-sinc weights that pass an eighth of the rate and less."""
    import numpy as np

    at = np.arange(window) - window // 2
    raw = np.sinc(at / 4) * np.hamming(window)
    return (raw / raw.sum()).tolist()


def smooth(rr: DataFrame, how: str = "savgol", keys: Sequence[str] = SEGMENT, window: int = 5, order: int = 2) -> DataFrame:
    """smooth: Savitzky-Golay, median, or a windowed-sinc low pass; null where the window isn't full."""
    half, w = window // 2, Window.partitionBy(*keys).orderBy("i")
    if how == "median":
        got = F.array_sort(F.collect_list("rr").over(w.rowsBetween(-half, half)))
        return rr.withColumn("smooth", F.when(F.size(got) == window, F.get(got, F.lit(half))))
    if how == "savgol":
        weights = savitzky_golay_weights(window, order)
    elif how == "lowpass":
        weights = lowpass_weights(window)
    else:
        raise ValueError(f"how is savgol, median or lowpass, not {how}")
    at = [F.lag("rr", half - k).over(w) if k < half else F.lead("rr", k - half).over(w) if k > half else F.col("rr") for k in range(window)]
    total = at[0] * weights[0]
    for x, k in zip(at[1:], weights[1:], strict=True):
        total = total + x * k
    return rr.withColumn("smooth", total)


def signal_quality(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Beats, mean, sd, RMSSD, NN50, a score in [0, 1] and its label."""
    d = rr.withColumn("d", F.col("rr") - F.lag("rr").over(Window.partitionBy(*keys).orderBy("i")))
    s = d.groupBy(*keys).agg(F.count("*").alias("n_beats"), F.avg("rr").alias("mean_rr"), F.stddev_pop("rr").alias("sd_rr"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.count_if(F.abs("d") > 50).alias("nn50"))
    s = s.withColumn("rmssd", F.coalesce("rmssd", F.lit(0.0)))
    score = (clip01(F.col("n_beats") / 100) + clip01(F.col("sd_rr") / F.col("mean_rr") / 0.1) + clip01(F.col("rmssd") / 30)) / 3
    s = s.withColumns({"pnn50": ratio(100 * F.col("nn50"), F.col("n_beats") - 1), "score": score})
    label = F.when(F.col("score") >= 0.8, "excellent").when(F.col("score") >= 0.6, "good").when(F.col("score") >= 0.4, "fair").when(F.col("score") >= 0.2, "poor").otherwise("very_poor")
    return s.withColumn("label", label)


def median_rr(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    return rr.groupBy(*keys).agg(median("rr").alias("median_rr"))
