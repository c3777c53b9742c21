"""Post-hoc tests, repeated measures, power, the choice of a test and normality votes, over small tables of group moments.

Raw rows are read in one aggregation per test, as in `stats`; what runs in Arrow batches are distribution functions on one row
per comparison.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pulseloom.functions.dist import beta_inc, gamma_inc, normal_cdf, p_chi2, p_f, p_t, t_two_sided
from pulseloom.functions.ordered import running
from pulseloom.operators.models import anderson_darling, ks_normal, ols, with_residuals
from pulseloom.operators.stats import anova, levene, pairwise, wilcoxon

# Post-hoc tests


def studentized_range_upper(q: float, k: int, df: float) -> float:
    """P(range of k normal means over the pooled deviation > q), by quadrature over the deviation and the range."""
    if not (q > 0 and k > 1):
        return 1.0
    z = np.linspace(-8, 8, 801)
    step, density = z[1] - z[0], np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inside = lambda w: float((k * density * (normal_cdf(z) - normal_cdf(z - w)) ** (k - 1)).sum() * step)
    if math.isinf(df) or df > 20_000:
        return max(0.0, 1 - inside(q))
    s = np.linspace(max(1e-6, 1 - 8 / math.sqrt(2 * df)), 1 + 8 / math.sqrt(2 * df), 161)
    log = df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2 + math.log(2)
    weight = np.exp(log)
    return float(np.clip(1 - (weight * [inside(q * x) for x in s]).sum() / weight.sum(), 0, 1))


@F.pandas_udf(DoubleType())
def _range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(a) else studentized_range_upper(a, int(b), math.inf if pd.isna(c) else c) for a, b, c in zip(q, k, df, strict=True)])


def _pairs(groups: DataFrame, *columns: str) -> DataFrame:
    """All pairs a < b of the groups of a metric: columns with _a and _b."""
    one = groups.select("metric", F.col("grp").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    other = groups.select(F.col("metric").alias("metric_b"), F.col("grp").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return one.join(other, (F.col("metric") == F.col("metric_b")) & (F.col("a") < F.col("b"))).drop("metric_b")


def tukey(long: DataFrame) -> DataFrame:
    """q, difference and p of Tukey and Kramer's test for all pairs of groups."""
    g = long.groupBy("metric", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("n > 1")
    all_ = Window.partitionBy("metric")
    g = g.withColumns({"k": F.count("*").over(all_), "df": (F.sum("n").over(all_) - F.count("*").over(all_)).cast("double")})
    g = g.withColumn("within", F.sum((F.col("n") - 1) * F.col("v")).over(all_) / F.col("df"))
    j = _pairs(g, "n", "m", "k", "df", "within")
    se = F.sqrt(F.col("within_a") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    j = j.withColumns({"difference": F.col("m_a") - F.col("m_b"), "q": F.try_divide(F.abs(F.col("m_a") - F.col("m_b")), se)})
    return j.select("metric", "a", "b", "difference", "q", F.col("df_a").alias("df"), _range_p("q", "k_a", "df_a").alias("p_value"))


def block_ranks(blocks: DataFrame) -> DataFrame:
    """rank: the average rank of a value within its block."""
    below = Window.partitionBy("metric", "block").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = F.count("*").over(Window.partitionBy("metric", "block", "value"))
    return blocks.withColumn("rank", F.count("*").over(below) - (ties - 1) / 2)


def nemenyi(blocks: DataFrame) -> DataFrame:
    """q and p for all pairs of groups from their mean ranks over complete blocks."""
    g = block_ranks(blocks).groupBy("metric", "grp").agg(F.avg("rank").alias("m"), F.count("*").alias("n"))
    g = g.withColumn("k", F.count("*").over(Window.partitionBy("metric")))
    j = _pairs(g, "m", "n", "k")
    q = F.abs(F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("k_a") * (F.col("k_a") + 1) / (6.0 * F.col("n_a")))
    j = j.withColumn("q", q * math.sqrt(2))
    return j.select("metric", "a", "b", (F.col("m_a") - F.col("m_b")).alias("rank_difference"), "q", _range_p("q", "k_a", F.lit(None).cast("double")).alias("p_value"))


def paired(blocks: DataFrame) -> DataFrame:
    """Paired t and Cohen's d_z, and Wilcoxon's signed ranks, for all pairs of groups over their common blocks."""
    one = blocks.select("metric", "block", F.col("grp").alias("a"), F.col("value").alias("x"))
    other = blocks.select("metric", "block", F.col("grp").alias("b"), F.col("value").alias("y"))
    j = one.join(other, ["metric", "block"]).where("a < b").withColumn("pair", F.concat_ws("|", "metric", "a", "b"))
    d = F.col("x") - F.col("y")
    t = j.groupBy("pair", "metric", "a", "b").agg(F.count("*").alias("n"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("sd"))
    t = t.withColumns({"d_z": F.try_divide("difference", "sd"), "t": F.try_divide("difference", F.col("sd") / F.sqrt("n"))}).withColumn("p_value", p_t(F.col("t"), F.col("n") - 1))
    w = wilcoxon(j.select("pair", "x", "y"), "pair").select("pair", "w_plus", "w_minus", F.col("p_value").alias("wilcoxon_p"))
    return t.join(w, "pair", "left").drop("pair", "sd")


# Repeated measures


def repeated_anova(blocks: DataFrame) -> DataFrame:
    """F, degrees of freedom, partial eta squared and p over complete blocks: the blocks' own level is taken out."""
    s = blocks.groupBy("metric").agg(F.avg("value").alias("grand"))
    g = blocks.groupBy("metric", "grp").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    b = blocks.groupBy("metric", "block").agg(F.avg("value").alias("m"), F.count("*").alias("k"))
    total = blocks.join(s, "metric").groupBy("metric").agg(F.sum((F.col("value") - F.col("grand")) ** 2).alias("total"))
    between = g.join(s, "metric").groupBy("metric").agg(F.count("*").alias("groups"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"))
    rows = b.join(s, "metric").groupBy("metric").agg(F.count("*").alias("blocks"), F.sum(F.col("k") * (F.col("m") - F.col("grand")) ** 2).alias("rows"))
    j = total.join(between, "metric").join(rows, "metric").withColumn("error", F.col("total") - F.col("between") - F.col("rows"))
    df1, df2 = (F.col("groups") - 1).cast("double"), ((F.col("groups") - 1) * (F.col("blocks") - 1)).cast("double")
    j = j.withColumns({"df1": df1, "df2": df2}).withColumn("f", F.try_divide(F.col("between") / F.col("df1"), F.col("error") / F.col("df2")))
    return j.select("metric", "f", "df1", "df2", F.try_divide("between", F.col("between") + F.col("error")).alias("partial_eta_squared"), p_f(F.col("f"), F.col("df1"), F.col("df2")).alias("p_value"))


def aligned_ranks(blocks: DataFrame) -> DataFrame:
    """The repeated-measures F over the ranks of values less their block's mean, ranked within the metric by counts of distinct values."""
    d = blocks.withColumn("aligned", F.round(F.col("value") - F.avg("value").over(Window.partitionBy("metric", "block")), 9))
    c = d.groupBy("metric", "aligned").agg(F.count("*").alias("c"))
    c = running(c, ["metric"], "aligned", {"ahead": F.col("c")}).select("metric", "aligned", (F.col("ahead") + (F.col("c") + 1) / 2).alias("rank"))
    return repeated_anova(d.join(c, ["metric", "aligned"]).select("metric", "grp", "block", F.col("rank").alias("value")))


# Power


def noncentral_t_upper(t: float, df: float, delta: float) -> float:
    """P(T > t) of the noncentral t distribution, by quadrature over the deviation."""
    s = np.linspace(max(1e-6, 1 - 9 / math.sqrt(2 * df)), 1 + 9 / math.sqrt(2 * df), 2001)
    log = (df - 1) * np.log(s) - df * s * s / 2
    weight = np.exp(log - log.max())
    return float((weight * (1 - normal_cdf(t * s - delta))).sum() / weight.sum())


def t_critical(df: float, alpha: float) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(t_two_sided(mid, df)) > alpha else (lo, mid)
    return hi


#: Degrees of freedom from which the limiting laws stand for t and F; powers then differ by about 1 in so many.
LARGE = 20_000


def t_power(d: float, n: float, alpha: float = 0.05, paired_: bool = False) -> float:
    """Power of the two-sided t test with n a group (or n pairs) at the effect d."""
    df, delta = (n - 1, abs(d) * math.sqrt(n)) if paired_ else (2 * n - 2, abs(d) * math.sqrt(n / 2))
    if df < 1:
        return 0.0
    if df > LARGE:  # the normal law
        z, upto = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().cdf
        return upto(delta - z) + upto(-delta - z)
    c = t_critical(df, alpha)
    return noncentral_t_upper(c, df, delta) + 1 - noncentral_t_upper(-c, df, delta)


def anova_power(f: float, k: int, n: float, alpha: float = 0.05) -> float:
    """Power of the one-way F test with k groups of n at Cohen's f: a Poisson mixture of beta functions."""
    df1, df2, lam = k - 1.0, k * (n - 1.0), f * f * k * n
    if df2 < 1:
        return 0.0
    if df2 > LARGE:  # the noncentral chi-squared law, whose weights are those of central ones of df1 + 2 j
        lo, hi = 0.0, 10.0 * df1 + 100.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - float(gamma_inc(df1 / 2, mid / 2)) > alpha else (lo, mid)
        j = np.arange(max(0, int(lam / 2 - 12 * math.sqrt(lam / 2 + 1))), int(lam / 2 + 12 * math.sqrt(lam / 2 + 1)) + 20)
        if len(j) > 20_000:
            return 1.0
        weight = np.exp(-lam / 2 + j * math.log(max(lam, 1e-300) / 2) - np.array([math.lgamma(x + 1) for x in j]))
        return float(np.clip(1 - (weight * gamma_inc(df1 / 2 + j, np.full(len(j), hi / 2))).sum(), 0, 1))
    lo, hi = 0.0, 1.0  # of x = df1 F / (df1 F + df2)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - float(beta_inc(df1 / 2, df2 / 2, mid)) > alpha else (lo, mid)
    j = np.arange(0, int(lam / 2 + 12 * math.sqrt(lam / 2 + 1)) + 20)
    weight = np.exp(-lam / 2 + j * math.log(max(lam, 1e-300) / 2) - np.array([math.lgamma(x + 1) for x in j]))
    return float(np.clip(1 - (weight * beta_inc(df1 / 2 + j, np.full(len(j), df2 / 2), np.full(len(j), hi))).sum(), 0, 1))


def least_n(power_of, target: float = 0.8, most: int = 1 << 24, guess: float = 2) -> int | None:
    """The least n whose power reaches the target, by doubling and halving around a guess; None where `most` doesn't."""
    hi = int(min(most, max(2, guess)))
    while power_of(hi) < target:
        if hi >= most:
            return None
        hi = min(2 * hi, most)
    lo = hi // 2
    while lo > 1 and power_of(lo) >= target:
        lo, hi = lo // 2, lo
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if power_of(mid) >= target else (mid, hi)
    return hi


def power(comparisons: DataFrame, design: str = "two_sample", alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """power and required_n for each row's effect and n (a group, or pairs); design two_sample, paired or anova (effect is Cohen's f, with a column k)."""
    if design not in ("two_sample", "paired", "anova"):
        raise ValueError(f"design is two_sample, paired or anova, not {design}")

    @F.pandas_udf("struct<power:double,required_n:long>")
    def both(effect: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = []
        for e, size, groups in zip(effect, n, k, strict=True):
            if pd.isna(e) or pd.isna(size):
                out.append((math.nan, None))
                continue
            of = (lambda m, e=e, g=int(groups): anova_power(e, g, m, alpha)) if design == "anova" else (lambda m, e=e: t_power(e, m, alpha, design == "paired"))
            out.append((of(float(size)), least_n(of, target, guess=1.1 * 10 / e**2) if e else None))
        return pd.DataFrame(out, columns=["power", "required_n"]).astype({"required_n": "Int64"})

    k = F.col("k") if "k" in comparisons.columns else F.lit(2)
    return comparisons.withColumn("p_", both(F.col("effect").cast("double"), F.col("n").cast("double"), k.cast("double"))).select("*", "p_.power", "p_.required_n").drop("p_")


# Normality and the choice of a test


def dagostino(long: DataFrame) -> DataFrame:
    """z of skewness, z of kurtosis, their sum of squares K2 and its p; groups of 20 and more."""
    s = long.groupBy("metric", "grp").agg(F.count("value").cast("double").alias("n"), F.skewness("value").alias("skew"), (F.kurtosis("value") + 3).alias("b2")).where("n >= 20 and skew is not null")
    n = F.col("n")
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    s = s.withColumns({"y": y, "w2": w2}).withColumn("u", F.col("y") / F.sqrt(2 / (F.col("w2") - 1)))
    z1 = F.log(F.col("u") + F.sqrt(F.col("u") ** 2 + 1)) / F.sqrt(0.5 * F.log("w2"))
    x = (F.col("b2") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    g = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / g * (2 / g + F.sqrt(1 + 4 / (g * g)))
    s = s.withColumns({"z_skew": z1, "x": x, "a": a})
    cube = (1 - 2 / F.col("a")) / (1 + F.col("x") * F.sqrt(2 / (F.col("a") - 4)))
    s = s.withColumn("z_kurtosis", (1 - 2 / (9 * F.col("a")) - F.signum(cube) * F.pow(F.abs(cube), F.lit(1 / 3))) / F.sqrt(2 / (9 * F.col("a"))))
    s = s.withColumn("k2", F.col("z_skew") ** 2 + F.col("z_kurtosis") ** 2)
    return s.select("metric", "grp", "z_skew", "z_kurtosis", "k2", p_chi2(F.col("k2"), F.lit(2.0)).alias("p_value"))


def kolmogorov_p(d: Column, n: Column) -> Column:
    """The asymptotic p of a Kolmogorov distance, from the first terms of its series."""
    x = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    total = F.lit(0.0)
    for k in range(1, 9):
        total = total + 2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def anderson_p(a2: Column, n: Column) -> Column:
    """The p of Anderson and Darling's A2 with fitted mean and deviation, by the usual piecewise fit."""
    a = a2 * (1 + 0.75 / n + 2.25 / (n * n))
    p = F.when(a >= 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a)).when(a >= 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a)).when(a >= 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a)).otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def pairwise_power(long: DataFrame, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """power() of every pair of groups at its own Hedges g; n is the harmonic mean of the two groups' sizes."""
    n = long.groupBy("metric", "grp").agg(F.count("value").alias("n"))
    d = pairwise(long).select("metric", "a", "b", F.col("hedges_g").alias("effect")).join(n.toDF("metric", "a", "na"), ["metric", "a"]).join(n.toDF("metric", "b", "nb"), ["metric", "b"])
    return power(d.select("metric", "a", "b", "effect", (2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))).alias("n")), "two_sample", alpha, target)


def groups_power(long: DataFrame, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """power() of the one-way test of each metric at its own Cohen f; n is the mean size of its groups of two rows and more."""
    f = anova(long).select("metric", F.sqrt(F.col("eta_squared") / (1 - F.col("eta_squared"))).alias("effect"), (F.col("df1") + 1).alias("k"), ((F.col("df1") + F.col("df2") + 1) / (F.col("df1") + 1)).alias("n"))
    return power(f, "anova", alpha, target)


def normality(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera, K2, Kolmogorov and Anderson-Darling p per group, standard errors of skewness and kurtosis, and the vote of the tests."""
    s = long.groupBy("metric", "grp").agg(F.count("value").cast("double").alias("n"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))
    n = F.col("n")
    se = F.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3)))
    s = s.where("n > 3").withColumns({"skew_se": se, "kurtosis_se": 2 * se * F.sqrt((n * n - 1) / ((n - 3) * (n + 5))), "jb_p": p_chi2(n / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4), F.lit(2.0))})
    keys = ["metric", "grp"]
    s = s.join(dagostino(long).select(*keys, F.col("p_value").alias("k2_p")), keys, "left").join(ks_normal(long), keys).join(anderson_darling(long), keys)
    s = s.withColumns({"ks_p": kolmogorov_p(F.col("d"), n), "ad_p": anderson_p(F.col("a2"), n)})
    tests = ("jb_p", "k2_p", "ks_p", "ad_p")
    votes, ran = [F.when(F.col(c) > alpha, 1).otherwise(0) for c in tests], [F.col(c).isNotNull().cast("int") for c in tests]
    s = s.withColumns({"votes": sum(votes[1:], votes[0]), "tests": sum(ran[1:], ran[0])})
    # Below 20 values one of the tests doesn't run; shares of those that ran decide.
    share = F.col("votes") / F.col("tests")
    return s.select(*keys, "n", "skew", "skew_se", "kurtosis", "kurtosis_se", *tests, "votes", "tests", F.when(share >= 0.75, "normal").when(share <= 0.25, "not normal").otherwise("unclear").alias("verdict"))


def choose_test(long: DataFrame, alpha: float = 0.05, paired_: bool = False) -> DataFrame:
    """The test for each metric by its number of groups, normality, equality of variances and of sizes, and why."""
    g = normality(long, alpha).groupBy("metric").agg(F.count("*").alias("groups"), F.min((2 * F.col("votes") >= F.col("tests")).cast("int")).alias("normal"), (F.max("n") <= 1.5 * F.min("n")).alias("similar_sizes"), F.min("n").alias("least_n"))
    g = g.join(levene(long).select("metric", (F.col("p_value") > alpha).alias("equal_variances")), "metric").withColumn("normal", F.col("normal") == 1)
    two = F.col("groups") == 2
    if paired_:
        test = F.when(two & F.col("normal"), "paired_t").when(two, "wilcoxon").when(F.col("normal"), "repeated_anova").otherwise("friedman")
    else:
        test = F.when(two & F.col("normal") & F.col("equal_variances"), "student_t").when(two & F.col("normal"), "welch_t").when(two, "mann_whitney").when(F.col("normal") & F.col("equal_variances"), "anova").when(F.col("normal"), "welch_anova").otherwise("kruskal")
    after = F.when(two, "none").when(test == "anova", F.when(F.col("similar_sizes"), "tukey").otherwise("bonferroni_t")).when(test == "welch_anova", "games_howell").when(test.isin("kruskal"), "dunn").when(test == "friedman", "nemenyi").otherwise("paired_t")
    return g.select("metric", "groups", "normal", "equal_variances", "similar_sizes", test.alias("test"), after.alias("post_hoc"), F.when(F.col("least_n") < 20, "small groups: prefer rank tests").otherwise("sizes suffice").alias("note"))


# Linear models


def interaction(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """The terms of y on x, by and their product; the product's p tells an effect modification."""
    return ols(df.withColumn(f"{x}:{by}", F.col(x) * F.col(by)), y, [x, by, f"{x}:{by}"])


def effect_modification(df: DataFrame, y: str, x: str, stratum: str) -> DataFrame:
    """x's slope in every stratum, and the greatest difference from the pooled slope in percent."""
    s = df.groupBy(stratum).agg(F.regr_slope(y, x).alias("slope"), F.regr_count(y, x).alias("n"))
    pooled = df.agg(F.regr_slope(y, x).alias("pooled"))
    return s.join(F.broadcast(pooled)).withColumn("change_percent", 100 * F.abs(F.try_divide(F.col("slope") - F.col("pooled"), F.col("pooled"))))  # pooled is one row


def white(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """White's test: n R2 of squared residuals on the predictors, their squares and products; statistic, df, p."""
    terms = {f"w{i}_{j}": F.col(a) * F.col(b) for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j}
    r = with_residuals(df, y, xs).withColumn("r2_", F.col("residual") ** 2).withColumns(terms)
    fit = ols(r, "r2_", [*xs, *terms]).agg(F.max(F.col("n") * F.col("r2")).alias("white"))
    return fit.select("white", F.lit(float(len(xs) + len(terms))).alias("df"), p_chi2(F.col("white"), F.lit(float(len(xs) + len(terms)))).alias("p_value"))


def influence(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """n, rows with leverage over 2 p / n, rows with Cook's distance over 4 / n, and the greatest of both.

    The driver holds the inverse of the small matrix of products; leverages are column expressions over the rows.
    """
    d = with_residuals(df.dropna(subset=[y, *xs]), y, xs).withColumn("one_", F.lit(1.0))
    names = ["one_", *xs]
    sums = d.agg(F.count("*").alias("n"), F.sum(F.col("residual") ** 2).alias("sse"), *[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    inverse = np.linalg.pinv(np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))], float))
    n, p = sums["n"], len(names)
    h = F.lit(0.0)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            h = h + F.col(a) * F.col(b) * float(inverse[i, j])
    variance = (sums["sse"] or 0.0) / max(1, n - p) or 1.0
    d = d.withColumn("h", h).withColumn("cook", F.col("residual") ** 2 / (p * variance) * F.try_divide("h", (1 - F.col("h")) ** 2))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("h") > 2 * p / max(1, n)).alias("n_leverage"), F.count_if(F.col("cook") > 4 / max(1, n)).alias("n_influential"), F.max("h").alias("max_leverage"), F.max("cook").alias("max_cook"))
