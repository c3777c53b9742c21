"""Group statistics over a long table (metric, grp, value): all metrics in one job.

Moment tests take one aggregation. Rank tests take counts per distinct (metric, value) and their running sum over slices of the
values, so ties are exact and no task sorts a whole metric.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import correlation, median, ratio
from pulseloom.functions.dist import normal_quantile, p_chi2, p_f, p_t, p_z, q_t
from pulseloom.functions.ordered import SLICES, running


# The percentiles that a description lists beside the quartiles.
PERCENTILES = (1, 5, 10, 20, 30, 40, 60, 70, 80, 90, 95, 99)


def describe(long: DataFrame) -> DataFrame:
    """Moments, quartiles, PERCENTILES, fences, spread and outliers per (metric, grp); all percentiles come from one buffer."""
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, **{f"p{p}": p / 100 for p in PERCENTILES}}
    s = long.groupBy("metric", "grp").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"), F.percentile("value", F.array(*map(F.lit, wanted.values()))).alias("at"),
    )
    s = s.withColumns({name: F.col("at")[k] for k, name in enumerate(wanted)}).drop("at")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    s = s.withColumns({"lower_bound": F.col("q1") - fence, "upper_bound": F.col("q3") + fence})
    d = long.join(s.select("metric", "grp", F.col("median").alias("m"), F.col("lower_bound").alias("lo"), F.col("upper_bound").alias("hi")), ["metric", "grp"])
    d = d.groupBy("metric", "grp").agg(median(F.abs(F.col("value") - F.col("m"))).alias("mad"), F.count_if(~F.col("value").between(F.col("lo"), F.col("hi"))).alias("n_outliers"))
    return s.join(d, ["metric", "grp"]).withColumns({"cv": F.try_divide("std", "mean"), "value_range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1")})


def mode(long: DataFrame) -> DataFrame:
    """The most frequent value, the least of them in a tie, and how often."""
    c = long.groupBy("metric", "grp", "value").agg(F.count("*").alias("c"))
    return c.groupBy("metric", "grp").agg(F.max(F.struct("c", (-F.col("value")).alias("v"))).alias("x")).select("metric", "grp", (-F.col("x.v")).alias("mode"), F.col("x.c").alias("n"))


def jarque_bera(long: DataFrame) -> DataFrame:
    s = long.groupBy("metric", "grp").agg(F.count("value").alias("n"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4)
    return s.withColumn("jb", jb).withColumn("p_value", p_chi2(F.col("jb"), F.lit(2.0)))


def two_groups(long: DataFrame, a: str, b: str) -> DataFrame:
    """Moments of two groups side by side: na, ma, va, nb, mb, vb."""
    own = lambda f, g: f(F.when(F.col("grp") == g, F.col("value")))
    return long.where(F.col("grp").isin(a, b)).groupBy("metric").agg(own(F.count, a).alias("na"), own(F.avg, a).alias("ma"), own(F.var_samp, a).alias("va"), own(F.count, b).alias("nb"), own(F.avg, b).alias("mb"), own(F.var_samp, b).alias("vb"))


def t_test(long: DataFrame, a: str, b: str, equal: bool = False, level: float = 0.95) -> DataFrame:
    """Student's or Welch's t, degrees of freedom, difference of means with its standard error and interval (low, high), p."""
    m = two_groups(long, a, b)
    na, nb, va, vb = (F.col(c) for c in ("na", "nb", "va", "vb"))
    if equal:
        df, se = (na + nb - 2).cast("double"), F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb))
    else:
        df, se = F.try_divide((va / na + vb / nb) ** 2, (va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), F.sqrt(va / na + vb / nb)
    m = m.withColumns({"t": F.try_divide(F.col("ma") - F.col("mb"), se), "df": df, "difference": F.col("ma") - F.col("mb"), "se": se})
    m = m.withColumn("reach", q_t(F.lit(level), F.col("df")) * F.col("se"))
    return m.select("metric", "t", "df", "difference", "se", (F.col("difference") - F.col("reach")).alias("low"), (F.col("difference") + F.col("reach")).alias("high"), p_t(F.col("t"), F.col("df")).alias("p_value"))


def effect_sizes(long: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's d, Hedges' g, Glass's delta, point-biserial r, percent difference, and P(a > b) + P(a = b) / 2 from cumulative counts."""
    m = two_groups(long, a, b)
    na, nb, va, vb, diff = F.col("na"), F.col("nb"), F.col("va"), F.col("vb"), F.col("ma") - F.col("mb")
    d = F.try_divide(diff, F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)))
    m = m.select("metric", d.alias("cohen_d"), (d * (1 - 3 / (4 * (na + nb) - 9))).alias("hedges_g"), F.try_divide(diff, F.sqrt(vb)).alias("glass_delta"), F.try_divide(100 * diff, F.col("mb")).alias("percent_difference"), (d / F.sqrt(d * d + (na + nb) * (na + nb) / (na * nb))).alias("point_biserial"), (na * nb).alias("pairs"))
    c = running(value_counts(long, a, b), ["metric"], "value", {"below": F.col("cb")})
    wins = c.groupBy("metric").agg(F.sum(F.col("ca") * (F.col("below") + F.col("cb") / 2)).alias("wins"))
    return m.join(wins, "metric").withColumn("cles", F.col("wins") / F.col("pairs")).drop("wins", "pairs")


def value_counts(long: DataFrame, a: str, b: str) -> DataFrame:
    """metric, value, ca, cb: how often a value comes in either group."""
    d = long.where(F.col("grp").isin(a, b) & F.col("value").isNotNull())
    return d.groupBy("metric", "value").agg(F.count_if(F.col("grp") == a).alias("ca"), F.count_if(F.col("grp") == b).alias("cb"))


def tied(c: Column) -> Column:
    """c cubed less c, as a double: cubes of counts pass 64 bits from 2.1 million rows on."""
    x = c.cast("double")
    return x * x * x - x


def mann_whitney(long: DataFrame, a: str, b: str) -> DataFrame:
    """U of a, rank-biserial correlation, z with tie correction and p."""
    t = F.col("ca") + F.col("cb")
    c = running(value_counts(long, a, b), ["metric"], "value", {"ahead": t}).withColumn("rank", F.col("ahead") + (t + 1) / 2)
    s = c.groupBy("metric").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.sum(F.col("ca") * F.col("rank")).alias("ra"), F.sum(tied(t)).alias("ties"))
    na, nb = F.col("na"), F.col("nb")
    n, u = na + nb, F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.withColumns({"u": u, "z": F.when(sd > 0, (u - na * nb / 2.0) / sd)})
    return s.select("metric", "u", (2 * F.col("u") / (na * nb) - 1).alias("rank_biserial"), "z", p_z(F.col("z")).alias("p_value"))


def ks_two_sample(long: DataFrame, a: str, b: str) -> DataFrame:
    """The greatest gap d of the two distribution functions and the p-value of Kolmogorov's limiting law at sqrt(na nb / (na + nb)) d."""
    c = running(value_counts(long, a, b), ["metric"], "value", {"a": F.col("ca"), "b": F.col("cb")}, totals=True)
    gap = F.abs(F.try_divide(F.col("a") + F.col("ca"), "total_a") - F.try_divide(F.col("b") + F.col("cb"), "total_b"))
    s = c.withColumn("gap", gap).groupBy("metric").agg(F.max("gap").alias("d"), F.max("total_a").alias("na"), F.max("total_b").alias("nb"))
    return s.select("metric", "d", kolmogorov_p(F.col("d") * F.sqrt(F.try_divide(F.col("na") * F.col("nb"), F.col("na") + F.col("nb")))).alias("p_value"))


def kolmogorov_p(x: Column) -> Column:
    """P(K > x) of Kolmogorov's law: 100 terms of its alternating series; below 0.2 it is 1 to twelve digits."""
    term = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + term(k))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def anova(long: DataFrame) -> DataFrame:
    """One-way F, eta squared, p; and Welch's F with its degrees of freedom."""
    g = long.groupBy("metric", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("n > 1")
    all_ = Window.partitionBy("metric")
    w = F.try_divide("n", "v")
    g = g.withColumns({"grand": F.sum(F.col("n") * F.col("m")).over(all_) / F.sum("n").over(all_), "w": w, "sw": F.sum(w).over(all_), "centre": F.try_divide(F.sum(w * F.col("m")).over(all_), F.sum(w).over(all_))})
    s = g.groupBy("metric").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        F.sum(F.col("w") * (F.col("m") - F.col("centre")) ** 2).alias("wb"), F.sum((1 - F.try_divide("w", "sw")) ** 2 / (F.col("n") - 1)).alias("lam"),
    )
    k, n = F.col("k"), F.col("n")
    s = s.withColumns({"df1": (k - 1).cast("double"), "df2": (n - k).cast("double"), "f": F.try_divide(F.try_divide(F.col("between"), k - 1), F.try_divide(F.col("within"), n - k)), "eta_squared": F.try_divide(F.col("between"), F.col("between") + F.col("within"))})
    s = s.withColumns({"welch_f": F.try_divide(F.try_divide(F.col("wb"), k - 1), 1 + F.try_divide(2 * (k - 2), k * k - 1) * F.col("lam")), "welch_df2": F.try_divide(k * k - 1, 3 * F.col("lam"))})
    return s.select("metric", "f", "df1", "df2", "eta_squared", p_f(F.col("f"), F.col("df1"), F.col("df2")).alias("p_value"), "welch_f", "welch_df2", p_f(F.col("welch_f"), F.col("df1"), F.col("welch_df2")).alias("welch_p"))


def levene(long: DataFrame) -> DataFrame:
    """ANOVA of the absolute deviations from the group's median."""
    m = long.groupBy("metric", "grp").agg(median("value").alias("m"))
    d = long.join(m, ["metric", "grp"]).select("metric", "grp", F.abs(F.col("value") - F.col("m")).alias("value"))
    return anova(d).select("metric", F.col("f").alias("w"), "df1", "df2", "p_value")


def rank_sums(long: DataFrame) -> DataFrame:
    """metric, grp, n, rank_sum with average ranks over all groups, and the metric's tie sum."""
    d = long.where(F.col("value").isNotNull())
    c = running(d.groupBy("metric", "value").agg(F.count("*").alias("c")), ["metric"], "value", {"ahead": F.col("c")})
    c = c.select("metric", "value", "c", (F.col("ahead") + (F.col("c") + 1) / 2).alias("rank"))
    ties = c.groupBy("metric").agg(F.sum(tied(F.col("c"))).alias("ties"))
    g = d.groupBy("metric", "grp", "value").agg(F.count("*").alias("k")).join(c, ["metric", "value"])
    return g.groupBy("metric", "grp").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum")).join(ties, "metric")


def kruskal(long: DataFrame) -> DataFrame:
    """H with tie correction, epsilon squared, p."""
    s = rank_sums(long).groupBy("metric").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"), F.max("ties").alias("ties"))
    n = F.col("n")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.try_divide("ties", tied(n)))
    s = s.withColumns({"h": h, "df": (F.col("k") - 1).cast("double")})
    return s.select("metric", "h", "df", F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k")).alias("epsilon_squared"), p_chi2(F.col("h"), F.col("df")).alias("p_value"))


def pairwise(long: DataFrame) -> DataFrame:
    """Welch t, Hedges g and Bonferroni and Benjamini-Hochberg p for all pairs of groups, from the groups' moments."""
    m = long.groupBy("metric", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a = m.select("metric", F.col("grp").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
    b = m.select(F.col("metric").alias("mb_"), F.col("grp").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    j = a.join(b, (F.col("metric") == F.col("mb_")) & (F.col("a") < F.col("b")))
    na, nb, va, vb = (F.col(c) for c in ("na", "nb", "va", "vb"))
    se2 = va / na + vb / nb
    g = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))) * (1 - 3 / (4 * (na + nb) - 9))
    j = j.withColumns({"t": F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(se2)), "df": F.try_divide(se2**2, (va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), "hedges_g": g})
    j = j.select("metric", "a", "b", "t", "df", "hedges_g").withColumn("p_value", p_t(F.col("t"), F.col("df")))
    return adjust(j, ["metric"])


def dunn(long: DataFrame) -> DataFrame:
    """Dunn's z for all pairs of groups from rank sums."""
    r = rank_sums(long)
    total = r.groupBy("metric").agg(F.sum("n").alias("total"), F.max("ties").alias("t"))
    a = r.select("metric", F.col("grp").alias("a"), F.col("n").alias("na"), (F.col("rank_sum") / F.col("n")).alias("ra"))
    b = r.select(F.col("metric").alias("m2"), F.col("grp").alias("b"), F.col("n").alias("nb"), (F.col("rank_sum") / F.col("n")).alias("rb"))
    j = a.join(b, (F.col("metric") == F.col("m2")) & (F.col("a") < F.col("b"))).join(total, "metric")
    n = F.col("total")
    z = (F.col("ra") - F.col("rb")) / F.sqrt((n * (n + 1) / 12.0 - F.col("t") / (12.0 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb")))
    return adjust(j.select("metric", "a", "b", z.alias("z")).withColumn("p_value", p_z(F.col("z"))), ["metric"])


def adjust(tests: DataFrame, keys: list[str]) -> DataFrame:
    """p_bonferroni and p_bh over the tests of each group of keys; the tables are small."""
    w = Window.partitionBy(*keys)
    d = tests.withColumns({"k": F.row_number().over(w.orderBy("p_value")), "m": F.count("*").over(w)})
    back = w.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({"p_bonferroni": F.least(F.lit(1.0), F.col("p_value") * F.col("m")), "p_bh": F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("k")).over(back))}).drop("k", "m")


def wilcoxon(pairs: DataFrame, key: str = "metric") -> DataFrame:
    """Signed-rank sums of pairs (x, y) without zero differences: w_plus, w_minus, z, p."""
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 9)).where("d <> 0")
    c = d.groupBy(key, F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("plus"), F.count("*").alias("c"))
    c = running(c, [key], "size", {"ahead": F.col("c")}).withColumn("rank", F.col("ahead") + (F.col("c") + 1) / 2)
    s = c.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("c") - F.col("plus")) * F.col("rank")).alias("w_minus"), F.sum(tied(F.col("c"))).alias("ties"))
    n = F.col("n")
    s = s.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(n / 24.0 * (n + 1) * (2 * n + 1) - F.col("ties") / 48))
    return s.select(key, "n", "w_plus", "w_minus", "z", p_z(F.col("z")).alias("p_value"))


def friedman(blocks: DataFrame) -> DataFrame:
    """Friedman's chi-squared without tie correction and Kendall's W from rows (metric, block, grp, value) that are complete."""
    w = Window.partitionBy("metric", "block")
    below = w.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = F.count("*").over(Window.partitionBy("metric", "block", "value"))
    d = blocks.withColumn("rank", F.count("*").over(below) - (ties - 1) / 2)
    s = d.groupBy("metric", "grp").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).groupBy("metric").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("q"))
    k, n = F.col("k"), F.col("n")
    s = s.withColumn("chi2", 12.0 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1))
    return s.select("metric", "chi2", (F.col("chi2") / (n * (k - 1))).alias("kendall_w"), p_chi2(F.col("chi2"), (k - 1).cast("double")).alias("p_value"))


def correlations(df: DataFrame, metrics: list[str], others: list[str] | None = None) -> DataFrame:
    """a, b, n, r, p for all pairs of columns, or of one of `metrics` and one of `others`, over rows that have both: one aggregation."""
    pairs = [(a, b) for k, a in enumerate(metrics) for b in (metrics[k + 1 :] if others is None else others)]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double"))
    per = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(both(a, b, a)).alias("n"), correlation(both(a, b, a), both(a, b, b)).alias("r")) for a, b in pairs]
    d = df.agg(F.array(*per).alias("x")).select(F.inline("x"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return d.withColumn("p_value", F.when((F.abs("r") >= 1) & (F.col("n") > 2), 0.0).otherwise(p_t(t, F.col("n") - 2)))


def strongest(pairs: DataFrame, top: int = 10, least: float = 0.0) -> DataFrame:
    """The `top` pairs of correlations() by |r|, ties by name, with |r| over `least`: direction, and strength by 0.5 and 0.7."""
    size = F.abs("r")
    strength = F.when(size > 0.7, "strong").when(size > 0.5, "moderate").otherwise("weak")
    d = pairs.where(size > least).orderBy(F.desc(size), "a", "b").limit(top)
    return d.withColumns({"strength": strength, "direction": F.when(F.col("r") > 0, "positive").otherwise("negative")})


def _leaves(r: np.ndarray) -> list[int]:
    """Leaf order of Ward's clustering of columns at distance 1 - |r|; the cluster made first is the left one."""
    d = {(i, j): 1 - abs(r[i, j]) for i in range(len(r)) for j in range(i + 1, len(r))}
    inside, made = {i: [i] for i in range(len(r))}, len(r)
    while len(inside) > 1:
        i, j = min(d, key=lambda p: (d[p], p))
        between, a, b = d.pop((i, j)), inside.pop(i), inside.pop(j)
        for k, c in inside.items():
            far = [d.pop((min(k, x), max(k, x))) for x in (i, j)]
            n = [len(a) + len(c), len(b) + len(c), len(c)]
            d[k, made] = math.sqrt((n[0] * far[0] ** 2 + n[1] * far[1] ** 2 - n[2] * between**2) / (len(a) + len(b) + len(c)))
        inside[made] = a + b
        made += 1
    return inside.popitem()[1] if inside else []


def ordered_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """The whole matrix a, b, r, p_value with the places a_at and b_at that put like columns side by side (Ward's leaves over 1 - |r|).

    The driver sees one row a pair of columns. Columns without an r count as uncorrelated.
    """
    at = {m: k for k, m in enumerate(metrics)}
    half = correlations(df, metrics).collect()
    r = np.eye(len(metrics))
    for x in half:
        r[at[x["a"]], at[x["b"]]] = r[at[x["b"]], at[x["a"]]] = 0.0 if x["r"] is None else x["r"]
    place = {metrics[k]: p for p, k in enumerate(_leaves(r))}
    cells = [(x[i], x[j], x["r"], x["p_value"]) for x in half for i, j in (("a", "b"), ("b", "a"))] + [(m, m, 1.0, 0.0) for m in metrics]
    return df.sparkSession.createDataFrame([(*c, place[c[0]], place[c[1]]) for c in cells], "a string, b string, r double, p_value double, a_at int, b_at int")


def ranked(df: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Average ranks of each column, joined back on the keys: the input of a Spearman matrix."""
    out = df.select(*keys)
    for m in metrics:
        c = running(df.groupBy(F.col(m).alias("v")).agg(F.count("*").alias("c")), [], "v", {"ahead": F.col("c")})
        c = c.select("v", (F.col("ahead") + (F.col("c") + 1) / 2).alias(f"r_{m}"))
        out = out.join(df.select(*keys, m).join(c, F.col(m) == F.col("v")).select(*keys, f"r_{m}"), keys)
    return out.select(*keys, *[F.col(f"r_{m}").alias(m) for m in metrics])


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """slope, intercept, r2, standard error and p of the slope per group."""
    s = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    s = s.withColumn("se", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))))
    return s.select(*keys, "slope", "intercept", "r2", "n", "se", p_t(F.col("slope") / F.col("se"), (F.col("n") - 2)).alias("p_value"))


def decompose(series: DataFrame, period: int = 4) -> DataFrame:
    """trend, seasonal, residual of series (series_id, i, y), i from 0: a line, then means by position (8 points and more)."""
    w = Window.partitionBy("series_id")
    fit = series.groupBy("series_id").agg(F.regr_slope("y", "i").alias("slope"), F.regr_intercept("y", "i").alias("icpt"), F.count("*").alias("n")).where("n >= 4")
    d = series.join(fit, "series_id").withColumn("trend", F.col("icpt") + F.col("slope") * F.col("i")).withColumn("rest", F.col("y") - F.col("trend"))
    season = F.avg("rest").over(Window.partitionBy("series_id", F.col("i") % period)) - F.avg("rest").over(w)
    d = d.withColumn("seasonal", F.when(F.col("n") >= 8, season).otherwise(0.0)).withColumn("residual", F.col("rest") - F.col("seasonal"))
    return d.select("series_id", "i", "y", "trend", "seasonal", "residual")


def magnitude(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def bootstrap(long: DataFrame, statistic: Callable[[Column], Column] = F.avg, reps: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """estimate, low, high per (metric, grp): each row counts Poisson(1) times in each repetition, drawn from its key's hash.

    statistic builds an aggregate of a column. Rows need a column `id`. The reps x rows are summed in one aggregation.
    """
    d = long.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    u = (F.pmod(F.xxhash64("metric", "grp", "id", "rep", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    times = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).when(u < 0.99940582, 5).otherwise(6)
    d = d.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    got = d.groupBy("metric", "grp", "rep").agg(statistic(F.col("value")).alias("s"))
    tail = (1 - level) / 2
    ci = got.groupBy("metric", "grp").agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))
    return long.groupBy("metric", "grp").agg(statistic(F.col("value")).alias("estimate")).join(ci, ["metric", "grp"])


def _repetitions(counts: DataFrame, keys: list[str], reps: int, seed: int, draw: Callable) -> DataFrame:
    """keys, rep, n, s: number and sum of what draw(generator, c, share, reps) takes of the c rows of each value, from rows (keys, value, c, share).

    A value's draws depend on its key and the seed alone. Partitions add up their values, so reps rows a key and partition are shuffled.
    """
    names = [f"k{k}" for k in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *key, h, value, c, share = (x.to_pylist() for x in batch.columns)
            sums: dict[tuple, list[np.ndarray]] = {}
            for at, *k in zip(range(len(h)), *key, strict=True):
                n = draw(np.random.default_rng(h[at] % (1 << 64)), c[at], share[at], reps)
                n_s = sums.setdefault(tuple(k), [np.zeros(reps, np.int64), np.zeros(reps)])
                n_s[0] += n
                n_s[1] += n * value[at]
            for k, (n, total) in sums.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([x] * reps, pa.string()) for x in k], pa.array(np.arange(1, reps + 1), pa.int32()), pa.array(n), pa.array(total)], names=[*names, "rep", "n", "s"])

    d = counts.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)], F.xxhash64(*keys, "value", F.lit(seed)), F.col("value").cast("double"), "c", F.col("share").cast("double"))
    got = d.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", rep int, n long, s double")
    return got.groupBy(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "rep").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def bootstrap_means(long: DataFrame, reps: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """bootstrap of the mean from counts of distinct values: a value with c rows counts Poisson(c) times in each repetition."""
    d = long.where("value is not null")
    c = d.groupBy("metric", "grp", "value").agg(F.count("*").alias("c")).withColumn("share", F.lit(1.0))
    got = _repetitions(c, ["metric", "grp"], reps, seed, lambda g, n, share, size: g.poisson(n, size)).withColumn("s", F.try_divide("s", "n"))
    tail = (1 - level) / 2
    ci = got.groupBy("metric", "grp").agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))
    return d.groupBy("metric", "grp").agg(F.avg("value").alias("estimate")).join(ci, ["metric", "grp"])


def _without_replacement(g: np.random.Generator, own: int, rest: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """How many of `own` rows are among `taken` that are drawn from own + rest rows, for each repetition.

    numpy's draws end at 10^9 rows; beyond, the normal law of the same mean and variance stands for them.
    """
    rest = np.maximum(0, rest)
    if own + int(rest.max(initial=0)) < 1_000_000_000:
        return g.hypergeometric(own, rest, taken)
    total = own + rest
    share = taken / np.maximum(1, total)
    spread = np.sqrt(own * share * (1 - share) * rest / np.maximum(1, total - 1))
    return np.clip(np.rint(own * share + spread * g.standard_normal(len(rest))), np.maximum(0, taken - rest), np.minimum(own, taken)).astype(np.int64)


def shuffles(counts: DataFrame, reps: int, seed: int, slices: int = 64) -> DataFrame:
    """metric, rep, n, s: rows and sum of a first group of `na` rows in each shuffle, from rows (metric, value, c, na): c rows of a value.

    A metric's values are dealt to slices by hash. Which share of the first group falls into each slice is drawn first, a small table of
    slices x repetitions; then each slice deals its own share to its values. Every shuffle moves exactly na rows, and no metric is one task.
    """
    d = counts.select("metric", F.col("value").cast("double").alias("value"), F.col("c").cast("long").alias("c"), F.col("na").cast("long").alias("na"), F.pmod(F.xxhash64("value"), F.lit(slices)).cast("int").alias("slice"))

    def quotas(t: pa.Table) -> pa.Table:
        t = t.sort_by("slice")
        g = np.random.default_rng([seed, t["h"][0].as_py() % (1 << 63)])
        own = t["own"].to_pylist()
        left, rest, out = np.full(reps, t["na"][0].as_py(), np.int64), sum(own), []
        for n in own:
            rest -= n
            out.append(_without_replacement(g, n, np.full(reps, rest, np.int64), left))
            left = left - out[-1]
        return t.select(["metric", "slice"]).append_column("quota", pa.array(out, pa.list_(pa.int64())))

    def deal(t: pa.Table, quota: pa.Table) -> pa.Table:
        t = t.sort_by("value")
        left = quota["quota"].combine_chunks().flatten().to_numpy()
        n, total = left.copy(), np.zeros(reps)
        rest = int(t["c"].to_numpy().sum())
        g = np.random.default_rng([seed, t["h"][0].as_py() % (1 << 63), t["slice"][0].as_py()])
        for value, c in zip(t["value"].to_pylist(), t["c"].to_pylist(), strict=True):
            rest -= c
            took = _without_replacement(g, c, np.full(reps, rest, np.int64), left)
            left, total = left - took, total + took * value
        return pa.table({"metric": pa.array([t["metric"][0].as_py()] * reps, pa.string()), "rep": pa.array(np.arange(1, reps + 1, dtype=np.int32)), "n": pa.array(n), "s": pa.array(total)})

    d = d.withColumns({"metric": F.col("metric").cast("string"), "h": F.xxhash64("metric")})
    per = d.groupBy("metric", "slice").agg(F.sum("c").alias("own"), F.max("na").alias("na"), F.first("h").alias("h"))
    quota = per.groupBy("metric").applyInArrow(quotas, "metric string, slice int, quota array<long>")
    dealt = d.groupBy("metric", "slice").cogroup(quota.groupBy("metric", "slice")).applyInArrow(deal, "metric string, rep int, n long, s double")
    return dealt.groupBy("metric", "rep").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def permutation(long: DataFrame, a: str, b: str, reps: int = 10_000, seed: int = 11) -> DataFrame:
    """difference of means, and the share of label shuffles whose absolute difference reaches it; each shuffle keeps the groups' sizes."""
    first = F.col("grp") == a
    c = long.where(F.col("grp").isin(a, b) & F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count("*").alias("c"), F.count_if(first).alias("ca"))
    total = c.groupBy("metric").agg(F.sum("c").alias("all_n"), F.sum(F.col("c") * F.col("value")).alias("all_s"), F.sum("ca").alias("na"), F.sum(F.col("ca") * F.col("value")).alias("sa"))
    apart = lambda n, s: F.try_divide(F.col(s), F.col(n)) - F.try_divide(F.col("all_s") - F.col(s), F.col("all_n") - F.col(n))
    total = total.withColumn("difference", apart("na", "sa"))
    r = shuffles(c.join(total.select("metric", "na"), "metric"), reps, seed).join(total.drop("na"), "metric").withColumn("x", apart("n", "s"))
    # Sums in another order may differ in the last digits; such shuffles reach the difference.
    reaches = F.abs("x") >= F.abs("difference") * (1 - 1e-9)
    return r.groupBy("metric").agg(F.first("difference").alias("difference"), F.avg(reaches.cast("double")).alias("p_value"))


def bootstrap_quantiles(long: DataFrame, quantiles: Sequence[float] = (0.5,), reps: int = 1000, seed: int = 7, level: float = 0.95, slices: int = SLICES) -> DataFrame:
    """metric, grp, quantile, estimate, low, high: bootstrap intervals of quantiles (lines between order statistics), all repetitions at once.

    A value with c rows counts Poisson(c) times in each repetition, drawn from a hash of its key. Values lie in slices by quantiles of all;
    the first pass adds up each slice's draws, a small table tells in which slice each repetition's order statistics lie, and the second pass
    draws again and reads them there. A group without a value in some repetition leaves that one out.
    """
    keys = ["metric", "grp"]
    d = long.where("value is not null").groupBy(*keys, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    cuts = d.agg(F.percentile_approx("value", F.array(*[F.lit(k / slices) for k in range(1, slices)]), F.lit(100 * slices)).alias("cuts"))
    d = d.join(F.broadcast(cuts)).withColumns({"slice": F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(0)), "h": F.xxhash64(*keys, "value", F.lit(seed))}).drop("cuts")
    place = [*keys, "slice"]
    named = lambda more: ", ".join([*[f"{k} {long.schema[k].dataType.simpleString()}" for k in keys], more])

    def drawn(t: pa.Table) -> Iterator[tuple[float, np.ndarray]]:
        for value, c, h in zip(t["value"].to_pylist(), t["c"].to_pylist(), t["h"].to_pylist(), strict=True):
            yield value, np.random.default_rng(h % (1 << 64)).poisson(c, reps)

    def add_up(t: pa.Table) -> pa.Table:
        total = np.zeros(reps, np.int64)
        for _, n in drawn(t):
            total += n
        return t.slice(0, 1).select(place).append_column("total", pa.array([total], pa.list_(pa.int64())))

    def find(t: pa.Table) -> pa.Table:
        """For each slice the repetitions' numbers (from 0) of the order statistics that lie in it."""
        t = t.sort_by("slice")
        upto = np.cumsum(t["total"].combine_chunks().flatten().to_numpy().reshape(-1, reps), 0)
        out = []
        for k, q in enumerate(quantiles):
            at = (upto[-1] - 1) * q
            for side, wanted in enumerate((np.floor(at), np.ceil(at))):
                lies = (upto <= wanted).sum(0)
                for s in np.unique(lies[upto[-1] > 0]):
                    own = np.flatnonzero((lies == s) & (upto[-1] > 0))
                    out.append((int(s), k, side, own, (wanted[own] - (upto[s - 1][own] if s else 0)).astype(np.int64), (at - np.floor(at))[own]))
        rows = t.take(pa.array([x[0] for x in out], pa.int64())).select(place)
        for name, at, kind in (("k", 1, pa.int32()), ("side", 2, pa.int32()), ("reps", 3, pa.list_(pa.int64())), ("numbers", 4, pa.list_(pa.int64())), ("shares", 5, pa.list_(pa.float64()))):
            rows = rows.append_column(name, pa.array([x[at] for x in out], kind))
        return rows

    def read(t: pa.Table, wanted: pa.Table) -> pa.Table:
        asks = [(a["k"], a["side"], np.array(a["reps"]), np.array(a["numbers"]), np.array(a["shares"])) for a in wanted.to_pylist()]
        found, upto = [np.full(len(a[2]), np.nan) for a in asks], np.zeros(reps, np.int64)
        for value, n in drawn(t.sort_by("value")) if asks else ():
            upto += n
            for got, (_, _, own, number, _) in zip(found, asks, strict=True):
                got[np.isnan(got) & (upto[own] > number)] = value
        parts = [(k, own, got * (1 - share if side == 0 else share)) for got, (k, side, own, _, share) in zip(found, asks, strict=True)]
        first = t.slice(0, 1) if t.num_rows else wanted.slice(0, 1)
        size = sum(len(p[1]) for p in parts)
        out = first.select(keys).take(pa.array(np.zeros(size, np.int64)))
        out = out.append_column("k", pa.array(np.concatenate([np.zeros(0, np.int32), *[np.full(len(own), k, np.int32) for k, own, _ in parts]])))
        out = out.append_column("rep", pa.array(np.concatenate([np.zeros(0, np.int64), *[own for _, own, _ in parts]])))
        return out.append_column("x", pa.array(np.concatenate([np.zeros(0), *[x for _, _, x in parts]])))

    totals = d.groupBy(*place).applyInArrow(add_up, named("slice int, total array<long>"))
    wanted = totals.groupBy(*keys).applyInArrow(find, named("slice int, k int, side int, reps array<long>, numbers array<long>, shares array<double>"))
    got = d.groupBy(*place).cogroup(wanted.groupBy(*place)).applyInArrow(read, named("k int, rep long, x double"))
    got = got.groupBy(*keys, "k", "rep").agg(F.sum("x").alias("x"))
    tail = (1 - level) / 2
    ci = got.groupBy(*keys, "k").agg(F.percentile("x", F.lit(tail)).alias("low"), F.percentile("x", F.lit(1 - tail)).alias("high"))
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    est = long.where("value is not null").groupBy(*keys).agg(F.percentile(F.col("value").cast("double"), at).alias("est")).select(*keys, F.posexplode("est").alias("k", "estimate"))
    ci = ci.toDF(*[f"ci_{c}" for c in (*keys, "k")], "low", "high")
    same = F.col("k") == F.col("ci_k")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"ci_{c}"))
    return est.join(ci, same, "left").select(*keys, at[F.col("k")].alias("quantile"), "estimate", "low", "high")


def required_n(comparisons: DataFrame, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """n per group for each row's effect (cohen_d) by the normal approximation, and the label of the effect."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return comparisons.withColumns({"required_n": F.ceil(F.lit(2 * z * z) / (F.col("cohen_d") ** 2)), "magnitude": magnitude(F.col("cohen_d"))})


def intraclass(long: DataFrame) -> DataFrame:
    """Variance between and within groups and ICC(1) from one-way sums of squares."""
    g = long.groupBy("metric", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    w = Window.partitionBy("metric")
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("metric").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("b"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    inside = F.col("w") / (F.col("n") - F.col("k"))
    between = F.greatest(F.lit(0.0), (F.col("b") / (F.col("k") - 1) - inside) / n0)
    return s.select("metric", between.alias("between_variance"), inside.alias("within_variance"), ratio(between, between + inside).alias("icc"))
