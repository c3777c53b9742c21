"""Post-hoc tests, repeated measures, power, normality votes, filters and status tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import rounded
from pulseloom.functions.ordered import numbered
from pulseloom.operators import align, hrv, inference, rr, stats, timeagg
from pulseloom.plans.base import SAMPLES, beats, nn_sql
from pulseloom.plans.groups import ANOVA, LONG, METRICS, _long
from pulseloom.plans.hrv import TIME, r6
from pulseloom.sources.samples import event_samples, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return f

    return register


def blocks(s, d):
    """The k-th values of all five subjects as block k."""
    e = numbered(event_samples(s, d), ("subject",), ("t", "seq"), "block").select(F.lit("hr").alias("metric"), F.col("subject").alias("grp"), F.col("hr").alias("value"), "block")
    return e.withColumn("c", F.count("*").over(Window.partitionBy("block"))).where("c = 5").drop("c")


BLOCKS = f"WITH {SAMPLES}, ps AS (SELECT subject, hr, row_number() OVER (PARTITION BY subject ORDER BY t, seq) AS block FROM samples), bl AS (SELECT 'hr' AS metric, subject AS grp, block, hr AS value FROM ps QUALIFY count(*) OVER (PARTITION BY block) = 5)"
REPEATED = """gr AS (SELECT metric, avg(value) AS grand FROM {src} GROUP BY metric), gb AS (SELECT metric, count(*) AS groups, sum(n * pow(m - grand, 2)) AS b FROM (SELECT metric, grp, avg(value) AS m, count(*) AS n FROM {src} GROUP BY ALL) JOIN gr USING (metric) GROUP BY metric),
rb AS (SELECT metric, count(*) AS blocks, sum(n * pow(m - grand, 2)) AS r FROM (SELECT metric, block, avg(value) AS m, count(*) AS n FROM {src} GROUP BY ALL) JOIN gr USING (metric) GROUP BY metric), tb AS (SELECT metric, sum(pow(value - grand, 2)) AS t FROM {src} JOIN gr USING (metric) GROUP BY metric)
SELECT metric, round(b / (groups - 1) / ((t - b - r) / ((groups - 1) * (blocks - 1))), 6) AS f, CAST(groups - 1 AS DOUBLE) AS df1, CAST((groups - 1) * (blocks - 1) AS DOUBLE) AS df2, round(b / (b + t - b - r), 6) AS partial_eta_squared FROM gb JOIN rb USING (metric) JOIN tb USING (metric)"""
query("t10_repeated_anova", f"{BLOCKS}, {REPEATED.format(src='bl')}")(lambda s, d: inference.repeated_anova(blocks(s, d)).drop("p_value"))
query(
    "t10_aligned_ranks",
    f"{BLOCKS}, al AS (SELECT metric, grp, block, round(value - avg(value) OVER (PARTITION BY block), 9) AS v FROM bl), ar AS (SELECT metric, grp, block, (rank() OVER (ORDER BY v) * 2 + count(*) OVER (PARTITION BY v) - 1) / 2 AS value FROM al), {REPEATED.format(src='ar')}",
)(lambda s, d: inference.aligned_ranks(blocks(s, d)).drop("p_value"))
query(
    "t12_tukey",
    f"""WITH {LONG}, gm AS (SELECT metric, grp, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM lg GROUP BY metric, grp), gw AS (SELECT *, sum((n - 1) * v) OVER w / (sum(n) OVER w - count(*) OVER w) AS wi, CAST(sum(n) OVER w - count(*) OVER w AS DOUBLE) AS df FROM gm WINDOW w AS (PARTITION BY metric))
SELECT a.metric, a.grp AS a, b.grp AS b, round(a.m - b.m, 6) AS difference, round(abs(a.m - b.m) / sqrt(a.wi / 2 * (1 / a.n + 1 / b.n)), 6) AS q, a.df FROM gw a JOIN gw b ON a.metric = b.metric AND a.grp < b.grp""",
)(lambda s, d: inference.tukey(_long(s, d)).drop("p_value"))
query("t12_tukey_p")(lambda s, d: inference.tukey(_long(s, d)).select("metric", "a", "b", "p_value"))
query(
    "t12_nemenyi",
    f"""{BLOCKS}, fr AS (SELECT metric, grp, (rank() OVER (PARTITION BY block ORDER BY value) * 2 + count(*) OVER (PARTITION BY block, value) - 1) / 2 AS r FROM bl), fm AS (SELECT metric, grp, avg(r) AS m, count(*) AS n FROM fr GROUP BY ALL)
SELECT a.metric, a.grp AS a, b.grp AS b, round(a.m - b.m, 6) AS rank_difference, round(abs(a.m - b.m) / sqrt(5 * 6 / (6.0::DOUBLE * a.n)) * sqrt(2), 6) AS q FROM fm a JOIN fm b ON a.grp < b.grp""",
)(lambda s, d: inference.nemenyi(blocks(s, d)).drop("p_value"))
query(
    "t12_paired",
    f"""{BLOCKS}, df AS (SELECT a.metric, a.grp AS a, b.grp AS b, a.value - b.value AS x FROM bl a JOIN bl b ON a.block = b.block AND a.grp < b.grp), t AS (SELECT metric, a, b, count(*) AS n, avg(x) AS difference, avg(x) / stddev_samp(x) AS d_z FROM df GROUP BY ALL),
sr AS (SELECT a, b, d, (rank() OVER (PARTITION BY a, b ORDER BY abs(d)) * 2 + count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS r FROM (SELECT a, b, round(x, 9) AS d FROM df) WHERE d <> 0), w AS (SELECT a, b, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM sr GROUP BY ALL)
SELECT metric, a, b, n, round(difference, 6) AS difference, round(d_z, 6) AS d_z, round(d_z * sqrt(n), 6) AS t, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus FROM t LEFT JOIN w USING (a, b)""",
)(lambda s, d: inference.paired(blocks(s, d)).drop("p_value", "wilcoxon_p"))
MOMENTS = f"WITH {LONG}, c AS (SELECT *, avg(value) OVER (PARTITION BY metric, grp) AS m FROM lg), g AS (SELECT metric, grp, count(value)::DOUBLE AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS skew, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) AS b2 FROM c GROUP BY metric, grp HAVING count(value) >= 20)"
query(
    "t2_dagostino",
    MOMENTS
    + """, h AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM g),
k AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS u, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM h), z AS (SELECT metric, grp, ln(u + sqrt(u * u + 1)) / sqrt(0.5::DOUBLE * ln(w2)) AS z1, a, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS cube FROM k),
q AS (SELECT metric, grp, z1, (1 - 2 / (9 * a) - sign(cube) * pow(abs(cube), 1 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM z) SELECT metric, grp, round(z1, 5) AS z_skew, round(z2, 5) AS z_kurtosis, round(z1 * z1 + z2 * z2, 4) AS k2 FROM q""",
)(lambda s, d: inference.dagostino(_long(s, d)).select("metric", "grp", F.round("z_skew", 5).alias("z_skew"), F.round("z_kurtosis", 5).alias("z_kurtosis"), F.round("k2", 4).alias("k2")))
query("t2_normality")(lambda s, d: inference.normality(_long(s, d)))
query("t11_choose_test")(lambda s, d: inference.choose_test(_long(s, d)))
query("t27_power")(lambda s, d: inference.pairwise_power(_long(s, d)))
query("t27_power_anova")(lambda s, d: inference.groups_power(_long(s, d)))
query(
    "t21_effect_modification",
    "WITH p AS (SELECT regr_slope(l_extendedprice, l_quantity) AS pooled FROM lineitem), s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round(slope, 4) AS slope, n, round(pooled, 4) AS pooled, round(100 * abs((slope - pooled) / pooled), 4) AS change_percent FROM s, p",
    4,
)(lambda s, d: inference.effect_modification(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag"))
query("t21_interaction", digits=4)(lambda s, d: inference.interaction(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount"))
query("t22_white", digits=3)(lambda s, d: inference.white(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))
query(
    "t22_influence",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem),
r AS (SELECT n, l_extendedprice - a - b * l_quantity AS e, 1 / n + pow(l_quantity - mx, 2) / sxx AS h FROM lineitem, f), v AS (SELECT sum(e * e) / (any_value(n) - 2) AS v FROM r), c AS (SELECT n, h, e * e / (2 * v) * h / pow(1 - h, 2) AS cook FROM r, v)
SELECT count(*) AS n, count(*) FILTER (h > 4 / n) AS n_leverage, count(*) FILTER (cook > 4 / n) AS n_influential, round(max(h), 6) AS max_leverage, round(max(cook), 6) AS max_cook FROM c""",
)(lambda s, d: inference.influence(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]))

# G: rates and filters


def _signal(s, d):
    """Hourly mean heart rate of each subject as a signal of one sample an hour; g counts the hours that have samples."""
    e = event_samples(s, d).groupBy(F.col("subject").alias("signal_id"), F.floor(F.col("t") / 3600).alias("hour")).agg(F.avg("hr").alias("value"))
    return e.select("signal_id", F.row_number().over(Window.partitionBy("signal_id").orderBy("hour")).alias("g"), "value", (F.col("hour") * 3600.0).alias("t"))


SIGNALS = f"WITH {SAMPLES}, ho AS (SELECT subject AS signal_id, CAST(floor(t / 3600) AS BIGINT) AS hour, avg(hr) AS value FROM samples GROUP BY ALL), sg AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY hour) AS g, value, hour * 3600.0::DOUBLE AS t FROM ho)"
query("g7_to_rate", f"{SIGNALS} SELECT signal_id, CAST(floor(t * (1 / 21600.0::DOUBLE)) AS BIGINT) AS g, round(avg(value), 6) AS value FROM sg GROUP BY ALL")(lambda s, d: align.to_rate(_signal(s, d).select("signal_id", "t", "value"), 1 / 3600, 1 / 21600))
query(
    "g7_to_higher_rate",
    f"""{SIGNALS}, ld AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM sg WINDOW w AS (PARTITION BY signal_id ORDER BY t)), gg AS (SELECT *, unnest(generate_series(CAST(ceil(t * (1 / 1800.0::DOUBLE)) AS BIGINT), CAST(ceil(t2 * (1 / 1800.0::DOUBLE)) - 1 AS BIGINT))) AS h FROM ld WHERE t2 > t)
SELECT signal_id, h AS g, round(value + (h / (1 / 1800.0::DOUBLE) - t) / (t2 - t) * (v2 - value), 6) AS value FROM gg""",
)(lambda s, d: align.to_rate(_signal(s, d).select("signal_id", "t", "value"), 1 / 3600, 1 / 1800))


def _weighted(weights: list[float], value: str) -> str:
    half = len(weights) // 2
    at = lambda k: f"lag({value}, {half - k}) OVER w" if k < half else f"lead({value}, {k - half}) OVER w" if k > half else value
    return " + ".join(f"{at(k)} * {w!r}::DOUBLE" for k, w in enumerate(weights))


for _kind, _low, _high in (("low", None, 0.1), ("high", 0.1, None), ("band", 0.05, 0.2)):
    _weights = align.filter_weights(_kind, 1.0, _low, _high, 9)
    query(f"g8_{_kind}_pass", f"{SIGNALS} SELECT signal_id, g, round({_weighted(_weights, 'value')}, 6) AS filtered FROM sg WINDOW w AS (PARTITION BY signal_id ORDER BY g)")(
        lambda s, d, weights=_weights: align.filtered(_signal(s, d), weights).select("signal_id", F.col("g").cast("long").alias("g"), "filtered")
    )
query("r10_lowpass", f"WITH {nn_sql()} SELECT subject, sol, i, round({_weighted(rr.lowpass_weights(9), 'rr')}, 6) AS smooth FROM nn WINDOW w AS (PARTITION BY subject, sol ORDER BY i)")(
    lambda s, d: rr.smooth(beats(s, d), "lowpass", window=9).select("subject", "sol", F.col("i").cast("long").alias("i"), "smooth")
)

# H: status of key metrics

query(
    "h30_status",
    f"""WITH {nn_sql()}, {TIME.format(keys='subject, sol')}, u AS (UNPIVOT (SELECT subject, mean_nni, sdnn, rmssd, CAST(pnn50 AS DOUBLE) AS pnn50 FROM tt) ON mean_nni, sdnn, rmssd, pnn50 INTO NAME metric VALUE value), m AS (SELECT subject, metric, avg(value) AS value, count(*) AS n FROM u GROUP BY ALL),
ref(metric, p5, p25, p75, p95, risk) AS (VALUES ('sdnn', 25, 35, 50, 65, 20), ('rmssd', 20, 28, 48, 65, 15), ('pnn50', 3, 10, 26, 38, 3))
SELECT subject, m.metric, n, round(value, 4) AS value, CASE WHEN p5 IS NULL THEN 'unknown' WHEN value < p5 THEN 'very_low' WHEN value < p25 THEN 'low' WHEN value <= p75 THEN 'normal' WHEN value <= p95 THEN 'high' ELSE 'very_high' END AS status, coalesce(value < risk, false) AS at_risk FROM m LEFT JOIN ref ON m.metric = ref.metric""",
    4,
)(lambda s, d: timeagg.assess(timeagg.unpivot(hrv.time_domain(beats(s, d)), ("subject",), METRICS).groupBy("subject", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))).select("subject", "metric", "n", "value", "status", "at_risk"))

# Statistics of queries whose p-values have no SQL

PHASED = f"WITH {SAMPLES}, b AS (SELECT min(sol) AS lo, (max(sol) - min(sol)) / 3 AS st FROM samples), lg AS (SELECT 'hr' AS metric, CASE WHEN sol <= lo + st THEN 'early' WHEN sol <= lo + 2 * st THEN 'mid' ELSE 'late' END AS grp, hr AS value FROM samples, b WHERE hr BETWEEN 30 AND 220)"
FACTORS = "WITH lg AS (SELECT 'l_returnflag' AS metric, l_returnflag AS grp, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_extendedprice FROM lineitem)"
RANKS = """rk AS (SELECT metric, grp, (rank() OVER (PARTITION BY metric ORDER BY value) * 2 + count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY metric, value) AS c FROM lg), rs AS (SELECT metric, grp, count(*)::DOUBLE AS n, sum(r) AS rank_sum, sum(c * c - 1) AS tt FROM rk GROUP BY metric, grp),
tie AS (SELECT metric, sum(tt)::DOUBLE AS ties, sum(n) AS total FROM rs GROUP BY metric),
kw AS (SELECT metric, count(*) AS k, any_value(total) AS n, (12 / (any_value(total) * (any_value(total) + 1)) * sum(rank_sum * rank_sum / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (pow(any_value(total), 3) - any_value(total))) AS h FROM rs JOIN tie USING (metric) GROUP BY metric)"""
query("t30_phase_tests", f"{PHASED}, {RANKS} SELECT metric, round(h, 5) AS h, CAST(k - 1 AS DOUBLE) AS df, round((h - k + 1) / (n - k), 6) AS epsilon_squared FROM kw")(
    lambda s, d: stats.kruskal(timeagg.phases_by_range(event_samples(s, d)).where(F.col("hr").between(30, 220)).select(F.lit("hr").alias("metric"), F.col("phase").alias("grp"), F.col("hr").alias("value"))).drop("p_value").withColumn("h", F.round("h", 5))
)
query("t29_factors_groups", f"{FACTORS}, {ANOVA.format(src='lg')}, {RANKS} SELECT av.metric AS factor, round(f, 5) AS f, round(eta_squared, 8) AS eta_squared, round(h, 4) AS h FROM av JOIN kw ON av.metric = kw.metric", 8)(
    lambda s, d: _factors(s, d)[0].select("factor", F.round("f", 5).alias("f"), "eta_squared", F.round("h", 4).alias("h"))
)
query(
    "t29_factors_lines",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS factor, round(regr_slope(l_extendedprice, {c}), 3) AS slope, round(regr_intercept(l_extendedprice, {c}), 3) AS intercept, round(regr_r2(l_extendedprice, {c}), 8) AS r2, count(*) AS n, round(sqrt((regr_syy(l_extendedprice, {c}) - regr_slope(l_extendedprice, {c}) * regr_sxy(l_extendedprice, {c})) / (count(*) - 2) / regr_sxx(l_extendedprice, {c})), 3) AS se FROM lineitem"
        for c in ("l_tax", "l_discount")
    ),
    8,
)(lambda s, d: _factors(s, d)[1].select("factor", *[F.round(c, 3).alias(c) for c in ("slope", "intercept", "se")], "r2", "n"))


def _factors(s, d):
    from pulseloom.operators.models import factors

    return factors(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], ["l_tax", "l_discount"])


_Z = (stats.normal_quantile(0.975) + stats.normal_quantile(0.8)) ** 2 * 2
query(
    "t27_required_n",
    f"""WITH {LONG}, m AS (SELECT metric, count(value) FILTER (grp = 'A') AS na, avg(value) FILTER (grp = 'A') AS ma, var_samp(value) FILTER (grp = 'A') AS va, count(value) FILTER (grp = 'R') AS nb, avg(value) FILTER (grp = 'R') AS mb, var_samp(value) FILTER (grp = 'R') AS vb FROM lg GROUP BY metric),
e AS (SELECT metric, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM m) SELECT metric, round(d, 6) AS cohen_d, CAST(ceil({_Z!r}::DOUBLE / (d * d)) AS BIGINT) AS required_n, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM e""",
)(lambda s, d: stats.required_n(stats.effect_sizes(_long(s, d), "A", "R")).select("metric", "cohen_d", "required_n", "magnitude"))

# Normality statistics: the rational approximations of the normal distribution, written out again.

_CUM = f"""WITH {LONG}, vc AS (SELECT metric, grp, value, count(*) AS c FROM lg GROUP BY ALL), cu AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY metric, grp ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(c) OVER (PARTITION BY metric, grp) AS n FROM vc)"""
_FITTED = f"""{_CUM}, st AS (SELECT metric, grp, avg(value) AS m, stddev_samp(value) AS s FROM lg GROUP BY ALL), zz AS (SELECT cu.*, (value - m) / s AS z, abs((value - m) / s) / sqrt(2) AS x FROM cu JOIN st USING (metric, grp)), tz AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM zz),
hz AS (SELECT *, 0.5::DOUBLE * t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x) AS half FROM tz), fz AS (SELECT *, CASE WHEN z >= 0 THEN 1 - half ELSE half END AS f FROM hz)"""
query("t2_ks_normal", f"{_FITTED} SELECT metric, grp, round(max(greatest((ahead + c) / n - f, f - ahead / n)), 5) AS d FROM fz GROUP BY ALL", 5)(lambda s, d: inference.ks_normal(_long(s, d)))
query(
    "t2_anderson_darling",
    f"{_FITTED}, pz AS (SELECT metric, grp, n, c, ahead, greatest(1e-12, least(1 - 1e-12, f)) AS f FROM fz) SELECT metric, grp, round(-max(n) - sum(c * ((2 * ahead + c) * ln(f) + (2 * (n - ahead) - c) * ln(1 - f))) / max(n), 3) AS a2 FROM pz GROUP BY ALL",
    3,
)(lambda s, d: inference.anderson_darling(_long(s, d)))
query(
    "t3_shapiro_francia",
    f"""{_CUM}, pr AS (SELECT *, (ahead + (c + 1) / 2 - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM cu), tq AS (SELECT *, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM pr),
xq AS (SELECT *, (CASE WHEN p < 0.5 THEN -1 ELSE 1 END) * (t - (2.515517::DOUBLE + t * (0.802853::DOUBLE + t * 0.010328::DOUBLE)) / (1 + t * (1.432788::DOUBLE + t * (0.189269::DOUBLE + t * 0.001308::DOUBLE)))) AS z FROM tq),
sq AS (SELECT metric, grp, sum(c) AS n, sum(c * value) AS x, sum(c * z) AS z, sum(c * value * value) AS xx, sum(c * z * z) AS zz, sum(c * value * z) AS xz FROM xq GROUP BY ALL) SELECT metric, grp, round(pow(xz - x * z / n, 2) / ((xx - x * x / n) * (zz - z * z / n)), 6) AS w_prime FROM sq""",
)(lambda s, d: _francia(s, d))


def _francia(s, d):
    from pulseloom.operators.models import shapiro_francia

    return shapiro_francia(_long(s, d))


def _inflation(s, d):
    from pulseloom.operators.models import inflation

    return inflation(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


query(
    "t22_vif",
    """WITH r AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'l_discount', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'l_tax', round((1 - a * a) / det, 6) FROM d""",
)(_inflation)
