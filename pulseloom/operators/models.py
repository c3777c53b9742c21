"""Linear models, diagnostics, normality, outliers and segment bootstraps.

A model's data are read once, as sums of products per group; what remains is a small solve per group in an Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import SEGMENT
from pulseloom.functions.dist import p_chi2, p_t
from pulseloom.functions.ordered import running
from pulseloom.operators.hrv import frequency_domain
from pulseloom.operators.stats import anova, correlations, kruskal, regression, strongest


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation, off by 1e-7 at most."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - half).otherwise(half)


def normal_score(p: Column) -> Column:
    """The normal quantile by a rational approximation in the tails' square-root logarithm, off by 5e-4 at most."""
    q = F.when(p < 0.5, p).otherwise(1 - p)
    t = F.sqrt(-2 * F.log(q))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(p < 0.5, -x).otherwise(x)


def _cumulated(long: DataFrame) -> DataFrame:
    """metric, grp, value, c, ahead, n: distinct values with how many come before."""
    c = long.where(F.col("value").isNotNull()).groupBy("metric", "grp", "value").agg(F.count("*").alias("c"))
    return running(c, ["metric", "grp"], "value", {"ahead": F.col("c")}, totals=True).withColumnRenamed("total_ahead", "n")


def ks_normal(long: DataFrame) -> DataFrame:
    """The greatest gap to the normal distribution of the group's mean and deviation."""
    s = long.groupBy("metric", "grp").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    d = _cumulated(long).join(s, ["metric", "grp"]).withColumn("f", normal_cdf((F.col("value") - F.col("m")) / F.col("s")))
    gap = F.greatest((F.col("ahead") + F.col("c")) / F.col("n") - F.col("f"), F.col("f") - F.col("ahead") / F.col("n"))
    return d.groupBy("metric", "grp").agg(F.max(gap).alias("d"))


def anderson_darling(long: DataFrame) -> DataFrame:
    """A squared against the fitted normal distribution, from ranks within the group."""
    s = long.groupBy("metric", "grp").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    d = _cumulated(long).join(s, ["metric", "grp"])
    f = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), normal_cdf((F.col("value") - F.col("m")) / F.col("s"))))
    # Over a run of c equal values at ranks a+1..a+c the weights 2i - 1 sum to c (2a + c), those from above to c (2(n - a) - c).
    part = F.col("c") * ((2 * F.col("ahead") + F.col("c")) * F.log(f) + (2 * (F.col("n") - F.col("ahead")) - F.col("c")) * F.log(1 - f))
    return d.groupBy("metric", "grp").agg((-F.max("n") - F.sum(part) / F.max("n")).alias("a2"))


def shapiro_francia(long: DataFrame) -> DataFrame:
    """Squared correlation of the values with normal scores of their ranks; any n."""
    d = _cumulated(long).withColumn("z", normal_score((F.col("ahead") + (F.col("c") + 1) / 2 - 0.375) / (F.col("n") + 0.25)))
    w, x, z = F.col("c"), F.col("value"), F.col("z")
    s = d.groupBy("metric", "grp").agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * z).alias("z"), F.sum(w * x * x).alias("xx"), F.sum(w * z * z).alias("zz"), F.sum(w * x * z).alias("xz"))
    n = F.col("n")
    top = (F.col("xz") - F.col("x") * F.col("z") / n) ** 2
    return s.select("metric", "grp", (top / ((F.col("xx") - F.col("x") ** 2 / n) * (F.col("zz") - F.col("z") ** 2 / n))).alias("w_prime"))


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, term, coef, se, t, p_value, n, r2, aic, bic of a linear model with intercept, over rows that have all its columns."""
    d = df.select(*keys, F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)]).dropna().withColumn("one", F.lit(1.0))
    cols, size = ["one", *[f"x{k}" for k in range(len(xs))]], len(xs) + 1
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("y")) for a in cols]).alias("xy"))

    @F.pandas_udf("array<struct<term:int,coef:double,se:double>>")
    def coefficients(n: pd.Series, yy: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for count, c, a, b in zip(n, yy, xx, xy, strict=True):
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = a
            m = m + np.triu(m, 1).T
            b = np.asarray(b, float)
            inverse = np.linalg.pinv(m)
            beta = inverse @ b
            rest = max(0.0, float(c - beta @ b))
            se = np.sqrt(np.maximum(np.diag(inverse), 0) * rest / max(1, count - size))
            out.append([{"term": k, "coef": float(beta[k]), "se": float(se[k])} for k in range(size)])
        return pd.Series(out)

    fit = sums.withColumn("fit", coefficients("n", "yy", "xx", "xy"))
    beta_xy = F.aggregate(F.zip_with(F.col("fit.coef"), F.col("xy"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    fit = fit.withColumn("sse", F.greatest(F.lit(1e-300), F.col("yy") - beta_xy))
    n = F.col("n")
    log_like = -n / 2 * (F.log(F.lit(2 * math.pi)) + F.log(F.col("sse") / n) + 1)
    fit = fit.withColumns({"r2": 1 - F.col("sse") / (F.col("yy") - F.col("sy") ** 2 / n), "aic": 2 * size - 2 * log_like, "bic": size * F.log(n) - 2 * log_like})
    out = fit.select(*keys, "n", "r2", "aic", "bic", F.inline("fit"))
    names = F.array(F.lit("intercept"), *[F.lit(x) for x in xs])
    t = F.when(F.col("se") > 0, F.col("coef") / F.col("se"))
    return out.select(*keys, F.element_at(names, F.col("term") + 1).alias("term"), "coef", "se", t.alias("t"), p_t(t, n - size).alias("p_value"), "n", "r2", "aic", "bic")


def confounding(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """x's coefficient crude and adjusted, and the change in percent; over 10 % counts as confounding."""
    crude = ols(df.dropna(subset=[y, x, *by]), y, [x]).where(F.col("term") == x).select(F.col("coef").alias("crude"))
    adjusted = ols(df, y, [x, *by]).where(F.col("term") == x).select(F.col("coef").alias("adjusted"))
    d = crude.join(F.broadcast(adjusted)).withColumn("change_percent", 100 * F.abs((F.col("adjusted") - F.col("crude")) / F.col("crude")))  # one row each
    return d.withColumn("confounded", F.col("change_percent") > 10)


def with_residuals(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """df with fitted and residual; the coefficients are one short row."""
    c = ols(df, y, xs).groupBy().pivot("term", ["intercept", *xs]).agg(F.first("coef")).select(F.col("intercept").alias("b0"), *[F.col(x).alias(f"b_{x}") for x in xs])
    fitted = F.col("b0")
    for x in xs:
        fitted = fitted + F.col(f"b_{x}") * F.col(x)
    return df.join(F.broadcast(c)).withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("b0", *[f"b_{x}" for x in xs])


def diagnostics(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Residual moments, Jarque-Bera, Breusch-Pagan with p, and the largest variance inflation."""
    r = with_residuals(df, y, xs).withColumn("r2_", F.col("residual") ** 2)
    m = r.agg(F.count("residual").alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"), F.skewness("residual").alias("skew"), F.kurtosis("residual").alias("kurtosis"))
    m = m.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4))
    bp = ols(r, "r2_", xs).agg(F.max(F.col("n") * F.col("r2")).alias("breusch_pagan")).withColumn("breusch_pagan_p", p_chi2(F.col("breusch_pagan"), F.lit(float(len(xs)))))
    return m.join(F.broadcast(bp)).join(F.broadcast(inflation(df, xs).agg(F.max("vif").alias("max_vif"))))  # one row each


def inflation(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """feature, vif: 1 / (1 - R2) of each column on the others."""
    out = None
    for x in xs:
        part = ols(df, x, [z for z in xs if z != x]).agg(F.max("r2").alias("r2")).select(F.lit(x).alias("feature"), (1 / (1 - F.col("r2"))).alias("vif"))
        out = part if out is None else out.union(part)
    return out


def mahalanobis_outliers(df: DataFrame, features: Sequence[str], share: float = 0.1, rounds: int = 3) -> DataFrame:
    """distance and outlier (the most distant share), with centre and covariance made anew from the rest in each round.

    The driver holds the centre and the covariance of the features; distances are column expressions.
    """
    kept, d = df, None
    for _ in range(rounds):
        names = list(features)
        s = kept.agg(*[F.avg(f).alias(f"m_{f}") for f in names], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for k, a in enumerate(names) for b in names[k:]]).first()
        cov = np.array([[s[f"c_{a}_{b}"] if i <= j else s[f"c_{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)], float)
        inverse = np.linalg.pinv(cov)
        total = F.lit(0.0)
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                total = total + (F.col(a) - s[f"m_{a}"]) * (F.col(b) - s[f"m_{b}"]) * float(inverse[i, j])
        d = df.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), total)))
        limit = d.agg(F.percentile_approx("distance", F.lit(1 - share), F.lit(10000)).alias("q")).first()["q"]
        kept = d.where(F.col("distance") <= limit).select(*df.columns)
    return d.withColumn("outlier", F.col("distance") > limit)


def isolation_outliers(df: DataFrame, features: Sequence[str], key: Sequence[str], share: float = 0.1, trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """score (0 to 1, high where random cuts part a row from the others early) and outlier (the `share` of highest scores).

    Each tree grows from `size` rows, as the method has it, out of trees x size rows at most that the driver draws by a hash of the key;
    every row is scored. Rows without one of the features score null and are no outliers.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    drawn = df.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], order.alias("h")).dropna().orderBy("h", *[f"f{k}" for k in range(len(features))]).limit(trees * size)
    rows = np.array([r[:-1] for r in drawn.collect()], float).reshape(-1, len(features))
    rnd = np.random.default_rng(seed)
    size = min(size, len(rows))
    depth = max(1, math.ceil(math.log2(max(2, size))))
    forest = [_isolation_tree(rnd, rows[rnd.choice(len(rows), size, replace=False)], depth) for _ in range(trees)] if size > 1 else []
    usual = _unsuccessful(size)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        x = np.array([[np.nan if v is None else v for v in row] for row in xs], float).reshape(len(xs), len(features))
        total = np.zeros(len(x))
        for feature, cut, low, high, length in forest:
            node = np.zeros(len(x), int)
            for _ in range(depth):
                inner = feature[node] >= 0
                below = x[np.arange(len(x)), np.maximum(feature[node], 0)] < cut[node]
                node = np.where(inner, np.where(below, low[node], high[node]), node)
            total += length[node]
        out = 2.0 ** (-total / max(1, len(forest)) / usual) if forest else np.full(len(x), 0.5)
        return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, out)).replace({np.nan: None}).astype("float64")

    d = df.withColumn("score", score(F.array(*[F.col(f).cast("double") for f in features]))).withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    limit = d.agg(F.percentile_approx("score", F.lit(1 - share), F.lit(10000)).alias("q"))
    return d.join(F.broadcast(limit)).withColumn("outlier", F.coalesce(F.col("score") > F.col("q"), F.lit(False))).drop("q")  # one row


def _unsuccessful(n: int) -> float:
    """Mean depth of a failed search in a binary tree of n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


def _isolation_tree(rnd: np.random.Generator, rows: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Nodes as arrays: feature (-1 at a leaf), cut, child below, child above, path length."""
    nodes, todo = [], [(rows, 0, None)]
    while todo:
        x, level, parent = todo.pop()
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 and level < depth else []
        if len(spread) == 0:
            nodes.append([-1, 0.0, 0, 0, level + _unsuccessful(len(x))])
            continue
        f = int(rnd.choice(spread))
        cut = float(rnd.uniform(x[:, f].min(), x[:, f].max()))
        at = len(nodes)
        nodes.append([f, cut, 0, 0, 0.0])
        todo += [(x[x[:, f] < cut], level + 1, (at, 2)), (x[x[:, f] >= cut], level + 1, (at, 3))]
    columns = list(zip(*nodes, strict=True))
    return tuple(np.array(c, kind) for c, kind in zip(columns, (int, float, int, int, float), strict=True))


def factors(df: DataFrame, outcome: str, categorical: Sequence[str], continuous: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Contextual factors of an outcome: ANOVA and Kruskal-Wallis per categorical one, a line per continuous one."""
    long = None
    for c in categorical:
        part = df.select(F.lit(c).alias("metric"), F.col(c).cast("string").alias("grp"), F.col(outcome).cast("double").alias("value")).where("grp is not null")
        long = part if long is None else long.union(part)
    groups = anova(long).select("metric", "f", "eta_squared", "p_value").join(kruskal(long).select("metric", "h", F.col("p_value").alias("kruskal_p")), "metric").withColumnRenamed("metric", "factor")
    rows = None
    for c in continuous:
        part = df.select(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x"), F.col(outcome).cast("double").alias("y")).dropna()
        rows = part if rows is None else rows.union(part)
    return groups, regression(rows, ["factor"], "y", "x")


def factor_model(df: DataFrame, outcomes: Sequence[str], factors: Sequence[str], confounders: Sequence[str] = ()) -> DataFrame:
    """outcome, model, term, coef, se, t, p_value, n, r2: each outcome on the factors together, crude and, with confounders, adjusted.

    Both models are over rows that have all columns. Text columns among factors and confounders become indicators of their levels but
    the first; levels are few by the columns' nature and come to the driver, at most 50 a column.
    """
    named = {}

    def terms(columns: Sequence[str]) -> list[str]:
        out = []
        for c in columns:
            if df.schema[c].dataType.typeName() != "string":
                out.append(c)
                continue
            levels = [r[0] for r in df.select(c).dropna().distinct().orderBy(c).limit(51).collect()]
            if len(levels) > 50:
                raise ValueError(f"{c} has over 50 levels")
            for v in levels[1:]:
                named[f"{c}={v}"] = F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double"))
                out.append(f"{c}={v}")
        return out

    crude, more = terms(factors), terms(confounders)
    d, out = df.dropna(subset=[*factors, *confounders]).withColumns(named) if named else df.dropna(subset=[*factors, *confounders]), None
    for y in outcomes:
        for model, xs in (("crude", crude), ("adjusted", [*crude, *more])):
            if model == "adjusted" and not more:
                continue
            part = ols(d, y, xs).select(F.lit(y).alias("outcome"), F.lit(model).alias("model"), "term", "coef", "se", "t", "p_value", "n", "r2")
            out = part if out is None else out.union(part)
    return out


def subgroup_lines(df: DataFrame, outcomes: Sequence[str], factors: Sequence[str], groups: Sequence[str], least: int = 20) -> DataFrame:
    """grouping, level, outcome, factor and regression() of the outcome on the factor within each level of `least` rows and more, in one job.

    n counts the rows that have outcome and factor; null levels are no subgroup.
    """
    cells = [
        F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("level"), F.lit(o).alias("outcome"), F.lit(c).alias("factor"), F.col(o).cast("double").alias("y"), F.col(c).cast("double").alias("x"))
        for g in groups for o in outcomes for c in factors
    ]
    keys = ["grouping", "level", "outcome", "factor"]
    d = regression(df.select(F.inline(F.array(*cells))).where("level is not null"), keys, "y", "x").where(F.col("n") >= least)
    return d.withColumn("r", F.signum("slope") * F.sqrt(F.greatest(F.lit(0.0), "r2")))


def insights(df: DataFrame, outcomes: Sequence[str], factors: Sequence[str], confounders: Sequence[str] = (), least_r: float = 0.5, least_r2: float = 0.2) -> DataFrame:
    """kind, outcome, factor, measure, finding: the three strongest of outcome and factor with |r| over least_r, and outcomes of which
    the factors (with the confounders, where given) explain more than least_r2."""
    pairs = strongest(correlations(df, list(outcomes), list(factors)), 3, least_r)
    text = F.format_string("strong %s association of %s and %s (r = %.3f)", "direction", "a", "b", "r")
    found = pairs.select(F.lit("association").alias("kind"), F.col("a").alias("outcome"), F.col("b").alias("factor"), F.col("r").alias("measure"), text.alias("finding"))
    fit = factor_model(df, outcomes, factors, confounders).where(F.col("model") == ("adjusted" if confounders else "crude")).where((F.col("term") == "intercept") & (F.col("r2") > least_r2))
    told = F.format_string("the factors explain %.1f %% of the variance of %s", 100 * F.col("r2"), "outcome")
    return found.union(fit.select(F.lit("model"), "outcome", F.lit(None).cast("string"), F.col("r2"), told))


def _draw(keys: Sequence[str], n: Column, seed: int, p: Column | None = None) -> Column:
    """The beat that draw p of repetition rep takes, 1 to n, from a hash of segment, repetition and draw."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("rep").cast("string"), (F.col("p") if p is None else p).cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n + 1).cast("int")


def _numbered(rr: DataFrame, keys: Sequence[str], reps: int) -> tuple[DataFrame, DataFrame]:
    """The beats to look up, and keys, rep, p, n: a row per repetition and draw.

    Beats repeat and pack well, so their tables look small: the lookups are hash joins of exchanged sides, never broadcasts.
    """
    d = rr.select(*keys, F.col("i").cast("int").alias("i"), "rr")
    draws = d.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).select(*keys, F.col("i").alias("p"), "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return d.hint("shuffle_hash"), draws


def resampled(rr: DataFrame, keys: Sequence[str] = SEGMENT, reps: int = 50, seed: int = 3) -> DataFrame:
    """keys, rep, i, rr: each repetition's n draws of a segment's n beats, numbered anew; a join on the beat's number, no sort of raw beats."""
    d, draws = _numbered(rr, keys, reps)
    return draws.withColumn("i", _draw(keys, F.col("n"), seed)).join(d, [*keys, "i"]).select(*keys, "rep", F.col("p").alias("i"), "rr")


def _interval(names: Sequence[str], level: float) -> list[Column]:
    tail = (1 - level) / 2
    return [F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in names for name, q in (("low", tail), ("high", 1 - tail))]


def bootstrap_intervals(rr: DataFrame, keys: Sequence[str] = SEGMENT, reps: int = 50, seed: int = 3, level: float = 0.95) -> DataFrame:
    """low and high of sdnn, rmssd, pnn50, sd1 and sd2 per segment over resampled beats; resampling loses their order.

    A draw looks up its own beat and that of the draw before it, so no repetition is sorted or held by one task.
    """
    d, draws = _numbered(rr, keys, reps)
    draws = draws.withColumns({"i": _draw(keys, F.col("n"), seed), "i_before": F.when(F.col("p") > 1, _draw(keys, F.col("n"), seed, F.col("p") - 1)).otherwise(0)})
    got = draws.select(*keys, "rep", "i", "i_before").join(d, [*keys, "i"]).select(*keys, "rep", "rr", F.col("i_before").alias("i"))
    before = rr.select(*keys, F.col("i").cast("int").alias("i"), F.col("rr").alias("rr_before"))
    got = got.join(before.union(before.select(*keys, F.lit(0), F.lit(None).cast("double")).distinct()).hint("shuffle_hash"), [*keys, "i"])
    got = got.withColumns({"d": F.col("rr") - F.col("rr_before"), "s": F.col("rr") + F.col("rr_before")})
    m = got.groupBy(*keys, "rep").agg(F.stddev_samp("rr").alias("sdnn"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmssd"), (100 * F.avg((F.abs("d") > 50).cast("double"))).alias("pnn50"), (F.stddev_pop("d") / math.sqrt(2)).alias("sd1"), (F.stddev_pop("s") / math.sqrt(2)).alias("sd2"))
    return m.groupBy(*keys).agg(*_interval(("sdnn", "rmssd", "pnn50", "sd1", "sd2"), level))


def bootstrap_bands(rr: DataFrame, keys: Sequence[str] = SEGMENT, reps: int = 50, seed: int = 3, level: float = 0.95) -> DataFrame:
    """low and high of lf_power, hf_power and lf_hf_ratio per segment over the spectra of resampled beats."""
    each = rr.select(*keys).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    m = frequency_domain(resampled(rr, keys, reps, seed), (*keys, "rep"), each)
    return m.groupBy(*keys).agg(*_interval(("lf_power", "hf_power", "lf_hf_ratio"), level))


def bootstrap_balance(rr: DataFrame, keys: Sequence[str] = SEGMENT, seed: int = 5, level: float = 0.95, longest: int = 500) -> DataFrame:
    """low and high of lf_hf, sympathovagal and complexity per segment, over 50 to 200 repetitions by the segment's beats; 0 below 50 beats.

    A repetition draws as many beats as there are, `longest` in segments of over 1,000. Its lf_hf is the power at 0.01 to 0.04 over
    that at 0.04 to 0.1 cycles a beat from 100 draws on, sdnn over rmssd below and without power, held to 0.1 to 15; sympathovagal is
    a fifth of it, complexity 15 times the variation, both at most 1. A segment's draws come from its one row, 100,000 at most.
    """
    d = rr.select(*keys, F.col("i").cast("int").alias("i"), "rr")
    each = d.groupBy(*keys).agg(F.count("*").alias("n"))
    n = F.col("n")
    draws = each.where("n >= 50").withColumn("rep", F.explode(F.sequence(F.lit(1), F.when(n < 100, 50).when(n < 1000, 100).when(n < 5000, 150).otherwise(200))))
    draws = draws.withColumn("p", F.explode(F.sequence(F.lit(1), F.when(n > 1000, F.lit(longest)).otherwise(n.cast("int")))))
    got = draws.withColumn("i", _draw(keys, n, seed)).join(d, [*keys, "i"])
    got = got.groupBy(*keys, "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "rr"))), lambda x: x["rr"]).alias("xs"), (F.stddev_samp("rr") / F.avg("rr")).alias("cv"))

    @F.pandas_udf("double")
    def balance(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: beat_balance(np.asarray(x, float)))

    got = got.withColumn("lf_hf", balance("xs")).withColumns({"sympathovagal": F.least(F.lit(1.0), F.col("lf_hf") / 5), "complexity": F.least(F.lit(1.0), 15 * F.col("cv"))})
    ci = got.groupBy(*keys).agg(*_interval(("lf_hf", "sympathovagal", "complexity"), level))
    return each.select(*keys).join(ci, list(keys), "left").fillna(0.0, [c for c in ci.columns if c not in keys])


def beat_balance(x: np.ndarray) -> float:
    """Low over high power of beats by cycles a beat, else deviation over successive differences; within 0.1 and 15."""
    step = math.sqrt(float(np.mean(np.diff(x) ** 2)))
    out = float(x.std(ddof=1)) / step if step > 0 else 1.0
    if len(x) >= 100:
        power = np.abs(np.fft.rfft(x / x.mean() - 1)) ** 2
        at = np.arange(len(power)) / len(x)
        high = float(power[(at >= 0.04) & (at <= 0.1)].sum())
        if high > 1e-18:
            out = float(power[(at >= 0.01) & (at <= 0.04)].sum()) / high
    return min(15.0, max(0.1, out))
