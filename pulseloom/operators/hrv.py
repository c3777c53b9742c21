"""Heart-rate variability per segment, over beats (keys, i, rr). Every domain is one plan keyed by segment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import SEGMENT, clip01, correlation, median, ratio, rounded
from pulseloom.functions.lineage import settle
from pulseloom.operators import boxes
from pulseloom.operators.rr import resample


@dataclass
class Shared:
    """What several domains need of the same beats: the beats, their moments and their bands, one row per segment of the latter two."""

    beats: DataFrame
    moments: DataFrame
    bands: DataFrame

    @classmethod
    def settled(cls, rr: DataFrame, keys: Sequence[str] = SEGMENT) -> Shared:
        """Each made once and kept as a table, for analyses of many domains."""
        beats = settle(rr.select(*keys, "i", "rr"))
        return cls(beats, settle(_moments(beats, keys)), settle(frequency_domain(beats, keys)))

    @classmethod
    def of(cls, rr: DataFrame, keys: Sequence[str] = SEGMENT) -> Shared:
        return cls(rr, _moments(rr, keys), frequency_domain(rr, keys))


def guard(rr: DataFrame) -> DataFrame:
    """Finite beats within [300, 2000] ms."""
    return rr.where(F.col("rr").between(300, 2000))


def with_differences(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("i")
    return rr.withColumns({"d": F.col("rr") - F.lag("rr").over(w), "s": F.col("rr") + F.lag("rr").over(w)})


def time_domain(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    """Level, spread and successive differences; 0 where a segment is too short for a metric."""
    a = shared.moments if shared else _moments(rr, keys)
    return a.select(*keys, *TIME_DOMAIN)


TIME_DOMAIN = ("n", "mean_nni", "sdnn", "rmssd", "nn50", "pnn50", "nn20", "pnn20", "sdsd", "cvsd", "cvnn", "mcv_nni", "median_nni", "mad_nni", "mean_hr", "std_hr", "min_hr", "max_hr")


def core(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """The usual time-domain and Poincare metrics from one aggregation on one exchange by segment."""
    return _moments(rr, keys).select(*keys, "n", "mean_nni", "sdnn", "rmssd", "pnn50", "sd1", "sd2")


def _moments(rr: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = with_differences(rr, keys).withColumn("med", median("rr").over(Window.partitionBy(*keys)))
    hr = F.lit(60000.0) / F.col("rr")
    a = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("rr").alias("mean_nni"),
        F.coalesce(F.stddev_samp("rr"), F.lit(0.0)).alias("sdnn"),
        F.max("med").alias("median_nni"),
        median(F.abs(F.col("rr") - F.col("med"))).alias("mad_nni"),
        F.coalesce(F.stddev_pop("d") / math.sqrt(2), F.lit(0.0)).alias("sd1"),
        F.coalesce(F.stddev_pop("s") / math.sqrt(2), F.lit(0.0)).alias("sd2"),
        F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0.0)).alias("rmssd"),
        F.count_if(F.abs("d") > 50).alias("nn50"),
        F.count_if(F.abs("d") > 20).alias("nn20"),
        F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sdsd"),
        F.avg(F.abs("d")).alias("mean_abs_d"),
        F.avg(hr).alias("mean_hr"),
        F.coalesce(F.stddev_samp(hr), F.lit(0.0)).alias("std_hr"),
        F.min(hr).alias("min_hr"),
        F.max(hr).alias("max_hr"),
        (F.stddev_pop("rr") / F.avg("rr")).alias("cv"),
        (F.max("rr") - F.min("rr")).alias("range_nn"),
        (F.sum("rr") / 60000).alias("minutes"),
    )
    return a.withColumns(
        {
            "pnn50": ratio(100 * F.col("nn50"), F.col("n") - 1),
            "pnn20": ratio(100 * F.col("nn20"), F.col("n") - 1),
            "cvsd": ratio(F.col("sdsd") * 100, F.col("mean_abs_d")),
            "cvnn": F.col("sdnn") / F.col("mean_nni") * 100,
            "mcv_nni": F.col("mad_nni") / F.col("median_nni") * 100,
        }
    )


def basic_table(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """The shorter table: population deviations, heart rate from the mean, longest and shortest beat; segments of 10 and more."""
    d = with_differences(rr, keys)
    a = d.groupBy(*keys).agg(
        F.count("*").alias("n_beats"), F.avg("rr").alias("mean_rr"), F.stddev_pop("rr").alias("sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"),
        F.count_if(F.abs("d") > 50).alias("nn50"), F.min("rr").alias("min_rr"), F.max("rr").alias("max_rr"), (F.max("rr") - F.min("rr")).alias("range_nn"),
    ).where("n_beats >= 10")
    return a.select(*keys, "n_beats", "mean_rr", "sdnn", "rmssd", (100 * F.col("nn50") / (F.col("n_beats") - 1)).alias("pnn50"), (60000 / F.col("mean_rr")).alias("mean_hr"), (60000 / F.col("max_rr")).alias("min_hr"), (60000 / F.col("min_rr")).alias("max_hr"), "range_nn")


def poincare(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    """sd1, sd2, sd2 / sd1 and the ellipse's area."""
    a = shared.moments if shared else with_differences(rr, keys).groupBy(*keys).agg((F.stddev_pop("d") / math.sqrt(2)).alias("sd1"), (F.stddev_pop("s") / math.sqrt(2)).alias("sd2"))
    a = a.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sd1", "sd2")])
    return a.withColumns({"sd1_sd2_ratio": ratio(F.col("sd2"), F.col("sd1")), "ellipse_area": F.lit(math.pi) * F.col("sd1") * F.col("sd2")})


def poincare_ellipse(rr: DataFrame, keys: Sequence[str] = SEGMENT, points: int = 100, scale: float = 5.991) -> DataFrame:
    """The 95 % ellipse around (mean, mean): k, x, y."""
    p = poincare(rr, keys).join(rr.groupBy(*keys).agg(F.avg("rr").alias("m")), list(keys))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    a = F.col("k") * (2 * math.pi / (points - 1))
    u, v = F.sqrt(F.lit(scale)) * F.col("sd2") * F.cos(a), F.sqrt(F.lit(scale)) * F.col("sd1") * F.sin(a)
    return p.select(*keys, "k", (F.col("m") + (u - v) / math.sqrt(2)).alias("x"), (F.col("m") + (u + v) / math.sqrt(2)).alias("y"))


def histogram_peak(rr: DataFrame, bins: int, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """n, lo, hi and the fullest of `bins` equal bins between the extremes; one bin where there is no spread."""
    s = rr.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rr").alias("lo"), F.max("rr").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("rr") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rr.join(s, list(keys)).groupBy(*keys, "n", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys, "n", "lo", "hi").agg(F.max("c").alias("peak"))


def triangular(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Triangular index and TINN from 128 bins; 0 below 50 beats."""
    h = histogram_peak(rr, 128, keys)
    index = F.when(F.col("n") >= 50, F.col("n") / F.col("peak")).otherwise(0.0)
    return h.select(*keys, (2 * index).alias("tinn"), index.alias("triangular_index"))


#: Name, from, up to (exclusive).
BANDS = (("vlf", 0.0033, 0.04), ("lf", 0.04, 0.15), ("hf", 0.15, 0.4))


def psd(rr: DataFrame, keys: Sequence[str] = SEGMENT, hz: float = 4.0, longest: int = 256, top: float = 0.4, least: int = 50) -> DataFrame:
    """Welch's spectrum on the regular grid: keys, nperseg, k, freq, power; frequencies below `top` only.

    The grid is detrended linearly, cut into windows of min(N / 4, longest) with half overlap, each less its mean, Hann
    weighted and transformed: grid points go to their windows by explode, a row per window carries its points, and numpy
    transforms these rows in Arrow batches.
    """
    # All windows below are over the segment: one exchange serves them.
    whole = Window.partitionBy(*keys)
    grid = resample(rr.withColumn("beats", F.count("*").over(whole)).where(F.col("beats") >= least), keys, hz, centre=True)
    d = grid.withColumns({"big_n": F.count("*").over(whole), "slope": F.regr_slope("x", "g").over(whole), "icpt": F.regr_intercept("x", "g").over(whole)})
    d = d.withColumn("m", F.least(F.floor(F.col("big_n") / 4), F.lit(longest)).cast("int")).where("m >= 4 and big_n >= 10")
    d = d.withColumn("hop", F.col("m") - F.floor(F.col("m") / 2).cast("int")).withColumn("windows", (F.floor((F.col("big_n") - F.col("m")) / F.col("hop")) + 1).cast("int"))
    d = d.withColumn("x", F.col("x") - F.col("slope") * F.col("g") - F.col("icpt"))
    first = F.greatest(F.lit(0), F.ceil((F.col("g") - F.col("m") + 1) / F.col("hop")))
    last = F.least(F.col("windows") - 1, F.floor(F.col("g") / F.col("hop")))
    d = d.withColumns({"first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    d = d.withColumn("w", F.explode(F.sequence("first", "last"))).withColumn("j", (F.col("g") - F.col("w") * F.col("hop")).cast("int"))
    # A window has `longest` points at most: its array is bounded, whatever the segment's length.
    arrays = d.groupBy(*keys, "m", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("xs"))

    @F.pandas_udf("array<double>")
    def periodogram(xs: pd.Series) -> pd.Series:
        out = np.empty(len(xs), object)
        sizes = xs.map(len).to_numpy()
        for m in np.unique(sizes):
            at = np.flatnonzero(sizes == m)
            x = np.stack(xs.iloc[at].to_list())
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
            power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * hann)) ** 2 / (hz * (hann**2).sum())
            power[:, 1 : (m + 1) // 2] *= 2
            for k, row in zip(at, power[:, : math.ceil(top / hz * m) + 1], strict=True):
                out[k] = row
        return pd.Series(out)

    d = arrays.select(*keys, "m", F.posexplode(periodogram("xs")).alias("k", "power"))
    out = d.groupBy(*keys, "m", "k").agg(F.avg("power").alias("power"))
    return out.select(*keys, F.col("m").alias("nperseg"), "k", (F.col("k") * hz / F.col("m")).alias("freq"), "power").where(F.col("freq") < top)


def band_of(freq: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        out = F.when((freq >= lo) & (freq < hi), name).otherwise(out)
    return out


def frequency_domain(rr: DataFrame, keys: Sequence[str] = SEGMENT, segments: DataFrame | None = None) -> DataFrame:
    """Powers per band by trapezoids inside the band, normalised units, shares and peaks; 0 where a segment is too short.

    `segments` are the keys of all segments, where known beforehand, so that the beats are gone through once.
    """
    p = psd(rr, keys).withColumn("band", band_of(F.col("freq"))).where("band is not null")
    w = Window.partitionBy(*keys, "band").orderBy("k")
    p = p.withColumn("area", (F.lead("power").over(w) + F.col("power")) / 2 * (F.lead("freq").over(w) - F.col("freq")))
    b = p.groupBy(*keys, "band").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("power"), F.max(F.struct("power", (-F.col("k")).alias("k"), "freq")).alias("top"))
    wide = b.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("band") == n, F.col("power"))), F.lit(0.0)).alias(f"{n}_power") for n, _, _ in BANDS],
        *[F.coalesce(F.max(F.when((F.col("band") == n) & (F.col("power") > 0), F.col("top.freq"))), F.lit(0.0)).alias(f"{n}_peak") for n, _, _ in BANDS],
    )
    wide = (segments or rr.select(*keys).distinct()).join(wide, list(keys), "left").fillna(0.0)
    lf, hf, vlf = F.col("lf_power"), F.col("hf_power"), F.col("vlf_power")
    total = vlf + lf + hf
    return wide.select(
        *keys, "vlf_power", "lf_power", "hf_power", total.alias("total_power"), ratio(100 * lf, lf + hf).alias("lf_nu"), ratio(100 * hf, lf + hf).alias("hf_nu"),
        ratio(lf, hf).alias("lf_hf_ratio"), *[ratio(100 * F.col(f"{n}_power"), total).alias(f"{n}_percent") for n, _, _ in BANDS], "vlf_peak", "lf_peak", "hf_peak",
    )


def dfa(rr: DataFrame, keys: Sequence[str] = SEGMENT, max_boxes: int | None = None) -> DataFrame:
    """Scaling exponents over boxes of 4 to 16 and 16 to 64 beats; 0 below 100 beats. All boxes, or the first max_boxes of each scale."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = rr.withColumns({"n": F.count("*").over(w), "mean": F.avg("rr").over(w)}).where("n >= 100")
    d = d.withColumn("y", F.sum(F.col("rr") - F.col("mean")).over(run))
    # Running sums of y, py and y^2: a box of any scale is the difference of two of them, so only box ends become rows, about 3 a beat.
    p = F.col("i").cast("double")
    d = d.withColumns({"s0": F.sum("y").over(run), "s1": F.sum(p * F.col("y")).over(run), "s2": F.sum(F.col("y") * F.col("y")).over(run)})
    top = F.least(F.lit(64), F.floor(F.col("n") / 4).cast("int") - 1)
    ends = d.withColumn("scale", F.explode(F.filter(F.sequence(F.lit(4), top), lambda s: F.col("i") % s == 0)))
    ends = ends.where(F.floor(F.col("n") / F.col("scale")) >= 4)
    if max_boxes:
        ends = ends.where(F.col("i") <= max_boxes * F.col("scale"))
    before = Window.partitionBy(*keys, "scale").orderBy("i")
    part = lambda c: F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0.0))
    boxes = ends.select(*keys, "scale", "i", part("s0").alias("y"), part("s1").alias("py"), part("s2").alias("y2"))
    size = F.col("scale").cast("double")
    middle = F.col("i") - (size - 1) / 2
    xy, xx = F.col("py") - middle * F.col("y"), (size**3 - size) / 12
    yy = F.col("y2") - F.col("y") * F.col("y") / size
    rms = F.sqrt(F.greatest(yy - xy * xy / xx, F.lit(0.0)) / size)
    f = boxes.groupBy(*keys, "scale").agg(F.avg(rms).alias("f"))
    f = f.withColumns({"lx": F.log10("scale"), "ly": F.when(F.col("f") > 0, F.log10("f"))})

    def slope(lo: int, hi: int) -> Column:
        own = F.col("scale").between(lo, hi)
        fitted = F.regr_slope(F.when(own, F.col("ly")), F.when(own, F.col("lx")))
        return F.when((F.count_if(own) > 2) & (F.count_if(own & F.col("ly").isNull()) == 0), fitted).otherwise(0.0)

    got = f.groupBy(*keys).agg(slope(4, 16).alias("dfa_alpha1"), slope(16, 64).alias("dfa_alpha2"))
    return rr.select(*keys).distinct().join(got, list(keys), "left").fillna(0.0)


#: Beats from which templates meet in cells of their first two values, not of the first alone; partitions of the cells.
LONG, CELL_TASKS = 1 << 21, 192


def entropy(rr: DataFrame, keys: Sequence[str] = SEGMENT, m: int = 2, r: float = 0.2, least: int = 50) -> DataFrame:
    """phi(m) - phi(m + 1) with self-matches, all templates, tolerance r x sd; 0 below `least` beats.

    Equal templates are one row with their number. Templates meet only in neighbouring cells of their first value, in segments of
    LONG beats and more of their first two, as wide as the tolerance; those of a cell are counted there, not paired (`operators.boxes`).
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy("i")
    d = rr.withColumns({"n": F.count("*").over(w), "tol": r * F.stddev_pop("rr").over(w)}).where(F.col("n") >= least)
    xs = [f"x{k}" for k in range(m + 1)]
    d = d.select(*keys, "n", "tol", *[F.lead("rr", k).over(o).alias(x) for k, x in enumerate(xs)]).where(F.col(xs[m - 1]).isNotNull())
    d = d.groupBy(*keys, "n", "tol", *xs).agg(F.count("*").alias("w"))
    bucket = lambda x: F.floor(F.col(x) / F.when(F.col("tol") > 0, F.col("tol")).otherwise(1.0))
    fine = (F.col("n") >= LONG) & F.lit(m > 1)
    d = d.withColumns({"p": bucket("x0"), "q": F.when(fine, bucket(xs[min(1, m - 1)])).otherwise(F.lit(0).cast("long"))})
    step = lambda p, q: F.struct(F.lit(p).alias("dp"), F.lit(q).alias("dq"))
    around = F.when(fine, F.array(*[step(p, q) for p in (-1, 0, 1) for q in (-1, 0, 1)])).otherwise(F.array(*[step(p, 0) for p in (-1, 0, 1)]))
    d = d.withColumn("at", F.explode(around))
    own = ((F.col("at.dp") == 0) & (F.col("at.dq") == 0)).alias("own")
    d = d.select(*keys, (F.col("p") + F.col("at.dp")).alias("p"), (F.col("q") + F.col("at.dq")).alias("q"), own, "n", "tol", "w", *xs)

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        asked = cell["own"].to_numpy()
        x, weight, tol = cell[xs].to_numpy(float, na_value=np.nan), cell["w"].to_numpy(np.int64), cell["tol"].iloc[0]
        out = cell.loc[asked, [*keys, "n", "w", xs[m]]].rename(columns={xs[m]: "last"})
        out["c"] = boxes.within(x[:, :m], weight, x[asked, :m], tol)
        out["c1"] = boxes.within(x, weight, x[asked], tol)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    cells = d.repartition(CELL_TASKS, *keys, "p", "q").groupBy(*keys, "p", "q")  # few bytes, much work: not to be coalesced
    hit = cells.applyInPandas(count, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n long, w long, last double, c long, c1 long"]))
    phi = F.sum(F.col("w") * F.log(F.col("c") / (F.col("n") - m + 1))) / F.sum("w")
    full = F.col("last").isNotNull()
    phi1 = F.sum(F.when(full, F.col("w") * F.log(F.col("c1") / (F.col("n") - m)))) / F.sum(F.when(full, F.col("w")))
    got = hit.groupBy(*keys).agg((phi - phi1).alias("sample_entropy")).withColumn("approximate_entropy", F.col("sample_entropy"))
    return rr.select(*keys).distinct().join(got, list(keys), "left").fillna(0.0)


def nonlinear(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    out = poincare(rr, keys, shared)
    for part in (dfa(rr, keys), entropy(rr, keys), triangular(rr, keys)):
        out = out.join(part, list(keys))
    return out


def extended(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    """What outside toolkits name besides: median, range, cardiac sympathetic and vagal index of the Poincare plot (T = 4 sd1, L = 4 sd2)."""
    a = shared.moments if shared else _moments(rr, keys)
    across, along = 4 * F.col("sd1"), 4 * F.col("sd2")
    return a.select(*keys, F.col("median_nni").alias("median_nn"), "range_nn", ratio(along, across).alias("csi"), F.when((across > 0) & (along > 0), F.log10(along * across)).otherwise(0.0).alias("cvi"), ratio(along * along, across).alias("modified_csi"))


def parasympathetic(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    known = shared or Shared.of(rr, keys)
    late = rr.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("i")))).where("back <= 100")
    late = late.groupBy(*keys).agg(F.stddev_pop("rr").alias("rsa_amplitude"))
    j = known.moments.select(*keys, "n", "rmssd", "pnn50", "sd1").join(known.bands.select(*keys, "hf_power", "hf_nu", "hf_peak", "total_power"), list(keys)).join(late, list(keys))
    index = (clip01(F.col("rmssd") / 100) + clip01(F.col("pnn50") / 50) + F.col("hf_nu") / 100 + clip01(F.col("sd1") / 50)) / 4
    vagal = 0.4 * F.col("hf_nu") / 100 + 0.25 * clip01(F.col("rmssd") / 100) + 0.2 * F.col("pnn50") / 100 + 0.15 * clip01(F.col("sd1") / 50)
    coherence = F.when((F.col("n") >= 50) & (F.col("hf_peak") > 0), clip01(ratio(10 * F.col("hf_power"), F.col("total_power")))).otherwise(0.0)
    return j.select(*keys, "hf_power", "rmssd", "pnn50", "sd1", "hf_nu", index.alias("parasympathetic_index"), "rsa_amplitude", F.col("hf_peak").alias("respiratory_frequency"), ratio(F.col("hf_power"), F.col("rmssd")).alias("hf_rmssd_ratio"), vagal.alias("vagal_tone_index"), coherence.alias("respiratory_coherence"))


def stress_index(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Share of the fullest of 50 bins over twice the range times the geometric mean of the extremes; 0 without a range."""
    h = histogram_peak(rr, 50, keys)
    return h.select(*keys, ratio(100 * F.col("peak") / F.col("n"), 2 * (F.col("hi") - F.col("lo")) * F.sqrt(F.col("lo") * F.col("hi"))).alias("stress_index"))


def sympathetic(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    known = shared or Shared.of(rr, keys)
    j = known.bands.join(stress_index(rr, keys), list(keys)).join(known.moments.select(*keys, "n", "sdnn", "mean_hr", "cv"), list(keys))
    si, lf = F.col("stress_index"), F.col("lf_power")
    index = (F.col("lf_nu") / 100 + clip01(F.col("lf_hf_ratio") / 5) + clip01(si / 100)) / 3
    cardiac = 0.5 * F.col("lf_nu") / 100 + 0.3 * clip01(si / 100) + 0.2 * F.when(F.col("mean_hr") > 60, clip01((F.col("mean_hr") - 60) / 60)).otherwise(0.0)
    modulation = F.when(F.col("sdnn") > 0, (F.when(lf > 0, clip01(F.log10(lf + 1) / 4)).otherwise(0.0) + clip01(F.col("sdnn") / 100)) / 2).otherwise(0.0)
    return j.select(
        *keys, "lf_power", "lf_nu", "lf_hf_ratio", "stress_index", index.alias("sympathetic_index"), ((F.col("hf_nu") - F.col("lf_nu")) / 100).alias("autonomic_balance"),
        F.col("lf_hf_ratio").alias("sympathovagal_balance"), cardiac.alias("cardiac_sympathetic_index"), modulation.alias("sympathetic_modulation"),
        F.when(F.col("n") >= 50, clip01(F.col("cv") / 0.1)).otherwise(0.0).alias("beta_adrenergic_sensitivity"),
    )


def reactivity(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Variation of the deviation over windows of min(30, n / 10) beats, at most 1; 0 below 100 beats."""
    d = rr.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n >= 100").withColumn("size", F.least(F.lit(30), F.floor(F.col("n") / 10)))
    d = d.withColumn("win", F.floor((F.col("i") - 1) / F.col("size"))).where(F.col("win") * F.col("size") < F.col("n") - F.col("size"))
    s = d.groupBy(*keys, "win").agg(F.stddev_pop("rr").alias("sd")).groupBy(*keys).agg(F.count("*").alias("c"), F.stddev_pop("sd").alias("s"), F.avg("sd").alias("m"))
    got = s.select(*keys, F.when(F.col("c") > 1, clip01(ratio(F.col("s"), F.col("m")))).otherwise(0.0).alias("autonomic_reactivity"))
    return rr.select(*keys).distinct().join(got, list(keys), "left").fillna(0.0)


def baroreflex(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """20 x the absolute correlation of a difference, negated, with the next one, at most 20; 0 below 100 beats."""
    w = Window.partitionBy(*keys).orderBy("i")
    d = with_differences(rr, keys).withColumn("d2", F.lead("d").over(w))
    got = d.groupBy(*keys).agg(F.count("*").alias("n"), correlation(-F.col("d"), F.col("d2")).alias("c"))
    return got.select(*keys, F.when(F.col("n") >= 100, F.least(F.lit(20.0), 20 * F.abs(F.coalesce("c", F.lit(0.0))))).otherwise(0.0).alias("baroreflex_sensitivity"))


def complexity(rr: DataFrame, keys: Sequence[str] = SEGMENT, scales: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Mean entropy over coarse-grained series of more than 50 points; 0 below 100 beats."""
    d = rr.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n >= 100").withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    d = d.withColumn("box", F.floor((F.col("i") - 1) / F.col("scale"))).where((F.col("box") + 1) * F.col("scale") <= F.col("n"))
    c = d.groupBy(*keys, "scale", "box").agg(F.avg("rr").alias("rr")).withColumn("i", F.col("box") + 1).drop("box")
    e = entropy(c, (*keys, "scale"), least=51)
    sizes = c.groupBy(*keys, "scale").agg(F.count("*").alias("points"))
    got = e.join(sizes, [*keys, "scale"]).where("points > 50").groupBy(*keys).agg(F.avg("sample_entropy").alias("ans_complexity"))
    return rr.select(*keys).distinct().join(got, list(keys), "left").fillna(0.0)


def rsa_coupling(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Correlation of HF power and RMSSD over windows of min(60, n / 4) beats with half hops; 0 below 100 beats or 4 windows."""
    d = rr.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n >= 100").withColumn("size", F.least(F.lit(60), F.floor(F.col("n") / 4)).cast("int"))
    d = d.withColumn("hop", F.floor(F.col("size") / 2).cast("int")).withColumn("windows", F.ceil((F.col("n") - F.col("size")) / F.col("hop")).cast("int"))
    at = F.col("i") - 1
    d = d.withColumns({"a": F.greatest(F.lit(0), F.ceil((at - F.col("size") + 1) / F.col("hop"))).cast("int"), "b": F.least(F.col("windows") - 1, F.floor(at / F.col("hop"))).cast("int")}).where("a <= b")
    d = d.withColumn("win", F.explode(F.sequence("a", "b"))).withColumn("i", (F.col("i") - F.col("win") * F.col("hop")).cast("int")).select(*keys, "win", "i", "rr")
    own = (*keys, "win")
    j = frequency_domain(d, own).select(*own, "hf_power").join(time_domain(d, own).select(*own, "rmssd"), list(own))
    got = j.groupBy(*keys).agg(F.count("*").alias("c"), correlation(F.col("hf_power"), F.col("rmssd")).alias("r")).select(*keys, F.when(F.col("c") > 3, F.coalesce("r", F.lit(0.0))).otherwise(0.0).alias("rsa_coupling_index"))
    return rr.select(*keys).distinct().join(got, list(keys), "left").fillna(0.0)


def ans_balance(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    known = shared or Shared.settled(rr, keys)
    rr = known.beats
    s = sympathetic(rr, keys, known).select(*keys, "lf_nu", "lf_hf_ratio", "stress_index", "sympathetic_index", "autonomic_balance")
    p = parasympathetic(rr, keys, known).select(*keys, "hf_nu", "parasympathetic_index")
    j = s.join(p, list(keys)).join(complexity(rr, keys), list(keys)).join(reactivity(rr, keys), list(keys)).join(baroreflex(rr, keys), list(keys))
    para, sym, si = F.col("parasympathetic_index"), F.col("sympathetic_index"), F.col("stress_index")
    traditional = clip01(F.when(F.col("hf_nu") > 0, F.col("lf_nu") / F.col("hf_nu")).otherwise(10.0) / 10)
    vagal = (traditional + ratio(si, si + para * 100, 0.5)) / 2
    return j.select(*keys, "lf_hf_ratio", "autonomic_balance", vagal.alias("sympathovagal_index"), "ans_complexity", ratio(para, para + sym, 0.5).alias("cardiac_autonomic_balance"), "autonomic_reactivity", "baroreflex_sensitivity")


def analysis_quality(rr: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Data quality by the number of beats, reliability by RMSSD and spectral power, minutes, recommendations."""
    known = Shared.of(rr, keys)
    j = known.moments.select(*keys, "n", "rmssd", "minutes").join(known.bands.select(*keys, "total_power"), list(keys))
    n, ok = F.col("n"), (F.col("rmssd") > 10).cast("int") + (F.col("total_power") > 100).cast("int")
    quality = F.when(n < 50, "poor").when(n < 200, "fair").when(n < 500, "good").otherwise("excellent")
    advice = F.array_compact(F.array(F.when(n < 50, "insufficient data").when(n < 200, "short recording"), F.when(F.col("rmssd") <= 10, "low rmssd"), F.when(F.col("total_power") <= 100, "low power"), F.when(ok < 2, "consider preprocessing")))
    return j.select(*keys, n.alias("n_intervals"), quality.alias("data_quality"), F.when(ok == 2, "high").otherwise("low").alias("reliability"), "minutes", F.when(F.size(advice) > 0, F.array_join(advice, ";")).otherwise("acceptable").alias("recommendations"))


DOMAINS = {
    "time": time_domain,
    "frequency": lambda rr, keys, shared: shared.bands,
    "nonlinear": nonlinear,
    "parasympathetic": parasympathetic,
    "sympathetic": sympathetic,
    "ans": ans_balance,
}


def analyse(rr: DataFrame, domains: Sequence[str] = tuple(DOMAINS), keys: Sequence[str] = SEGMENT) -> DataFrame:
    """The chosen domains side by side, columns named domain_metric. Beats, moments and bands are made once for all of them."""
    known, out = Shared.settled(rr, keys), None
    for d in domains:
        part = DOMAINS[d](known.beats, keys, known)
        part = part.select(*keys, *[F.col(c).alias(f"{d}_{c}") for c in part.columns if c not in keys])
        out = part if out is None else out.join(part, list(keys))
    return out


#: Columns of the phase table and the analysis columns that they are taken from.
PHASE_ROW = {
    "mean_nni": "time_mean_nni", "sdnn": "time_sdnn", "rmssd": "time_rmssd", "pnn50": "time_pnn50", "pnn20": "time_pnn20", "cvnn": "time_cvnn", "cvsd": "time_cvsd", "mean_hr": "time_mean_hr", "std_hr": "time_std_hr", "min_hr": "time_min_hr", "max_hr": "time_max_hr",
    "vlf_power": "frequency_vlf_power", "lf_power": "frequency_lf_power", "hf_power": "frequency_hf_power", "total_power": "frequency_total_power", "lf_nu": "frequency_lf_nu", "hf_nu": "frequency_hf_nu", "lf_hf_ratio": "frequency_lf_hf_ratio",
    "sd1": "nonlinear_sd1", "sd2": "nonlinear_sd2", "sd1_sd2_ratio": "nonlinear_sd1_sd2_ratio", "ellipse_area": "nonlinear_ellipse_area", "dfa_alpha1": "nonlinear_dfa_alpha1", "dfa_alpha2": "nonlinear_dfa_alpha2", "sample_entropy": "nonlinear_sample_entropy",
    "triangular_index": "nonlinear_triangular_index", "tinn": "nonlinear_tinn", "parasympathetic_index": "parasympathetic_parasympathetic_index", "rsa_amplitude": "parasympathetic_rsa_amplitude", "vagal_tone_index": "parasympathetic_vagal_tone_index",
    "stress_index": "sympathetic_stress_index", "sympathetic_index": "sympathetic_sympathetic_index", "cardiac_sympathetic_index": "sympathetic_cardiac_sympathetic_index", "autonomic_balance": "ans_autonomic_balance", "sympathovagal_index": "ans_sympathovagal_index",
    "ans_complexity": "ans_ans_complexity", "cardiac_autonomic_balance": "ans_cardiac_autonomic_balance", "autonomic_reactivity": "ans_autonomic_reactivity", "baroreflex_sensitivity": "ans_baroreflex_sensitivity",
}


def phase_rows(analysis: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """One wide row per segment with the plain names that phase comparisons use."""
    return analysis.select(*keys, *[F.col(c).alias(name) for name, c in PHASE_ROW.items()])


# The columns of the summary tables; a table has those of its columns that there are.
TABLES = {
    "basic": ("n", "mean_hr", "std_hr", "min_hr", "max_hr", "mean_nni", "sdnn", "cvnn"),
    "time": ("mean_nni", "sdnn", "rmssd", "nn50", "pnn50", "nn20", "pnn20", "cvnn", "cvsd"),
    "frequency": ("total_power", "vlf_power", "lf_power", "hf_power", "lf_hf_ratio", "lf_nu", "hf_nu"),
    "nonlinear": ("sd1", "sd2", "sd1_sd2_ratio", "ellipse_area"),
}


def complete_table(rr: DataFrame, keys: Sequence[str] = SEGMENT, shared: Shared | None = None) -> DataFrame:
    """Time-domain, spectral and Poincare columns of every segment, a row each."""
    known = shared or Shared.of(rr, keys)
    return time_domain(known.beats, keys, known).join(known.bands, list(keys)).join(poincare(known.beats, keys, known), list(keys))


def table_set(complete: DataFrame, name: str, keys: Sequence[str] = SEGMENT, digits: int = 2) -> DataFrame:
    """One of TABLES, or `complete`, rounded; nothing is computed that the table doesn't show. A table without any column is an error."""
    if name != "complete" and name not in TABLES:
        raise ValueError(f"{name} is not one of {[*TABLES, 'complete']}")
    have = [c for c in complete.columns if c not in keys and (name == "complete" or c in TABLES[name])]
    if not have:
        raise ValueError(f"no column of table {name}")
    return rounded(complete.select(*keys, *have), digits)
