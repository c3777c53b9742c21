"""Time buckets, joins and group statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import rounded
from pulseloom.functions.ordered import numbered
from pulseloom.operators import align, hrv, stats, timeagg
from pulseloom.plans.base import SAMPLES, SUBJECT, beats, nn_sql
from pulseloom.plans.hrv import FREQUENCY_COLUMNS, POINCARE, SPECTRUM, TIME, r6
from pulseloom.sources.samples import event_samples, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


DESCRIBE = "count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(quantile_cont({v}, 0.5), 6) AS median, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.75), 6) AS q3"
D = DESCRIBE.format(v="hr")

query("s12_calendar", f"WITH {SAMPLES} SELECT seq, hour(ts) AS hour, minute(ts) AS minute, dayname(ts) AS day_name, hour(ts) >= 19 OR hour(ts) < 7 AS is_night, CAST(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS INT) AS recording_day FROM samples")(
    lambda s, d: timeagg.calendar(event_samples(s, d)).select("seq", F.col("hour").cast("long").alias("hour"), F.col("minute").cast("long").alias("minute"), "day_name", "is_night", "recording_day")
)
query("s13_sol_from_dates", "SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER ()) / 86400000000) + 1 AS BIGINT) AS sol FROM orders")(
    lambda s, d: (lambda o: o.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("d")).join(F.broadcast(o.agg(F.min(F.col("o_orderdate").cast("timestamp_ntz")).alias("first")))).select("o_orderkey", (F.floor(F.timestamp_diff("MICROSECOND", "first", "d") / 86_400_000_000) + 1).alias("sol")))(table(s, d, "orders"))
)
query("s4_keyed_read", f"WITH {SAMPLES} SELECT subject, sol, seq, round(hr, 6) AS hr FROM samples WHERE subject IN ('click', 'view') AND sol BETWEEN 3 AND 9")(lambda s, d: event_samples(s, d).where(F.col("subject").isin("click", "view") & F.col("sol").between(3, 9)).select("subject", "sol", "seq", "hr"))
query("s5_dataset_info", f"WITH {SAMPLES} SELECT count(*) AS n, array_to_string(list_sort(list(DISTINCT subject)), ',') AS subjects, count(DISTINCT sol) AS n_sols, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t FROM samples")(
    lambda s, d: event_samples(s, d).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"), F.count_distinct("sol").alias("n_sols"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
)
query("g1_describe", f"WITH {SAMPLES} SELECT sol, subject, {D} FROM samples GROUP BY sol, subject")(lambda s, d: timeagg.describe(event_samples(s, d), ("sol", "subject"), "hr"))
query("g2_hour_stats", f"WITH {SAMPLES} SELECT subject, date_trunc('hour', ts) AS start, round(avg(hr), 6) AS mean, round(stddev_samp(hr), 6) AS std, count(hr) AS n, round(min(hr), 6) AS min, round(max(hr), 6) AS max FROM samples GROUP BY ALL")(lambda s, d: timeagg.hour_stats(event_samples(s, d), SUBJECT))
query("g3_hour_of_day", f"WITH {SAMPLES} SELECT subject, CAST(hour(ts) AS INT) AS hour, round(avg(hr), 6) AS mean, count(*) AS n FROM samples GROUP BY ALL")(lambda s, d: event_samples(s, d).groupBy("subject", F.hour("ts").alias("hour")).agg(F.avg("hr").alias("mean"), F.count("*").alias("n")))
query("g4_day_night", f"WITH {SAMPLES} SELECT subject, hour(ts) >= 19 OR hour(ts) < 7 AS is_night, {D} FROM samples GROUP BY ALL")(lambda s, d: timeagg.describe(event_samples(s, d).withColumn("is_night", timeagg.night(F.hour("ts"))), ("subject", "is_night"), "hr"))
query("g5_day_means", f"WITH {SAMPLES} SELECT subject, CAST(ts AS DATE) AS date, round(avg(hr), 6) AS mean, count(*) AS n FROM samples GROUP BY ALL")(lambda s, d: event_samples(s, d).groupBy("subject", F.to_date("ts").alias("date")).agg(F.avg("hr").alias("mean"), F.count("*").alias("n")))
query("g6_ten_minutes", f"WITH {SAMPLES} SELECT subject, time_bucket(INTERVAL 10 MINUTE, ts) AS start, round(avg(hr), 6) AS mean, count(hr) AS n FROM samples GROUP BY ALL")(lambda s, d: timeagg.bucket_means(event_samples(s, d), SUBJECT, "10 minutes"))
query("g9_pivot", f"WITH {SAMPLES} SELECT sol, " + ", ".join(f"round(avg(hr) FILTER (subject = '{x}'), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM samples GROUP BY sol")(lambda s, d: timeagg.pivot(event_samples(s, d), ["sol"], "subject", "hr"))
query("g9_pivot_all", f"WITH {SAMPLES} SELECT sol, " + ", ".join(f"round(avg(hr) FILTER (subject = '{x}'), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM samples GROUP BY sol")(lambda s, d: timeagg.pivot(event_samples(s, d), ["sol"], "subject", "hr"))
query("g10_completeness", "SELECT source, count(*) AS n, round(100 * count(lang) / count(*), 6) AS lang_percent, round(100 * count(quality) / count(*), 6) AS quality_percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")(
    lambda s, d: timeagg.completeness(table(s, d, "documents").select("doc_id", "source", "lang").join(table(s, d, "labels"), "doc_id", "left"), ("source",), ("lang", "quality"))
)
PHASES = f"WITH {SAMPLES}, b AS (SELECT min(sol) AS lo, (max(sol) - min(sol)) / 3 AS st FROM samples), ph AS (SELECT *, CASE WHEN sol <= lo + st THEN 'early' WHEN sol <= lo + 2 * st THEN 'mid' ELSE 'late' END AS phase FROM samples, b)"
query("g11_g12_phase_stats", PHASES + f" SELECT subject, phase, {D} FROM ph GROUP BY subject, phase")(lambda s, d: timeagg.describe(timeagg.phases_by_range(event_samples(s, d)), ("subject", "phase"), "hr"))
query("g13_quantile_phases", f"WITH {SAMPLES}, b AS (SELECT quantile_cont(sol, 0.33) AS a, quantile_cont(sol, 0.67) AS c FROM samples) SELECT CASE WHEN sol <= a THEN 'early' WHEN sol <= c THEN 'mid' ELSE 'late' END AS phase, count(*) AS n, min(sol) AS first_sol, max(sol) AS last_sol FROM samples, b GROUP BY 1")(
    lambda s, d: timeagg.phases_by_quantile(event_samples(s, d)).groupBy("phase").agg(F.count("*").alias("n"), F.min("sol").alias("first_sol"), F.max("sol").alias("last_sol"))
)
query("g14_crew_median", f"WITH {nn_sql()}, {TIME.format(keys='subject, sol')} SELECT sol, round(quantile_cont(rmssd, 0.5), 6) AS median, round(quantile_cont(rmssd, 0.25), 6) AS q1, round(quantile_cont(rmssd, 0.75), 6) AS q3, count(*) AS n FROM tt GROUP BY sol")(lambda s, d: timeagg.crew_median(hrv.time_domain(beats(s, d)), "sol", "rmssd"))
query(
    "g15_box_table",
    f"""WITH {SAMPLES}, q AS (SELECT subject, count(hr) AS n, quantile_cont(hr, 0.25) AS q1, quantile_cont(hr, 0.5) AS median, quantile_cont(hr, 0.75) AS q3 FROM samples GROUP BY subject)
SELECT subject, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(hr) FILTER (hr BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS low,
round(max(hr) FILTER (hr BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 6) AS high, count(*) FILTER (NOT hr BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outside FROM samples JOIN q USING (subject) GROUP BY subject""",
)(lambda s, d: timeagg.box_table(event_samples(s, d), SUBJECT, "hr"))
query(
    "g16_histogram",
    f"""WITH {SAMPLES}, l AS (SELECT subject, min(hr) AS lo, max(hr) AS hi FROM samples GROUP BY subject), b AS (SELECT subject, lo, hi, least(CAST(floor((hr - lo) / (hi - lo) * 50) AS INT), 49) AS bin FROM samples JOIN l USING (subject))
SELECT subject, bin, round(any_value(lo + bin * ((hi - lo) / 50)), 6) AS "left", count(*) AS n FROM b GROUP BY subject, bin""",
)(lambda s, d: timeagg.histogram(event_samples(s, d), SUBJECT, "hr"))
_T = "sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END))"
query(
    "g16_quantile_plot",
    f"""WITH {SAMPLES}, sz AS (SELECT subject, count(hr) AS n, least(count(hr), 200) AS steps FROM samples GROUP BY subject), rk AS (SELECT subject, hr, row_number() OVER (PARTITION BY subject ORDER BY hr) AS rank FROM samples WHERE hr IS NOT NULL),
pt AS (SELECT subject, n, k, CASE WHEN steps > 1 THEN (k * (n - 1)) // (steps - 1) ELSE 0 END + 1 AS rank FROM sz, range(200) AS q(k) WHERE k < steps), pp AS (SELECT *, (rank - 0.5::DOUBLE) / n AS p FROM pt), tt AS (SELECT *, {_T} AS t FROM pp)
SELECT subject, CAST(k AS INT) AS k, round((CASE WHEN p < 0.5 THEN -1 ELSE 1 END) * (t - (2.515517::DOUBLE + t * (0.802853::DOUBLE + t * 0.010328::DOUBLE)) / (1 + t * (1.432788::DOUBLE + t * (0.189269::DOUBLE + t * 0.001308::DOUBLE)))), 6) AS theoretical, round(hr, 6) AS hr FROM tt JOIN rk USING (subject, rank)""",
)(lambda s, d: timeagg.quantile_plot(event_samples(s, d), SUBJECT, "hr"))
query("g17_value_counts", "SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 10")(lambda s, d: table(s, d, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10))
ROLL = "ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING"
query("g18_rolling_mean", f"WITH {SAMPLES} SELECT subject, seq, round(avg(hr) OVER (PARTITION BY subject ORDER BY seq {ROLL.format(a=5, b=4)}), 6) AS rolling FROM samples")(lambda s, d: timeagg.rolling_mean(event_samples(s, d), SUBJECT, "seq", "hr", 10).select("subject", "seq", "rolling"))
query(
    "g23_variability_band",
    f"""WITH {SAMPLES} SELECT subject, seq, round(CASE WHEN count(hr) OVER w = 11 THEN avg(hr) OVER w END, 6) AS mid, round(CASE WHEN count(hr) OVER w = 11 THEN avg(hr) OVER w - stddev_samp(hr) OVER w END, 6) AS lower, round(CASE WHEN count(hr) OVER w = 11 THEN avg(hr) OVER w + stddev_samp(hr) OVER w END, 6) AS upper
FROM samples WINDOW w AS (PARTITION BY subject ORDER BY seq {ROLL.format(a=5, b=5)})""",
)(lambda s, d: timeagg.variability_band(event_samples(s, d), SUBJECT, "seq", "hr", 11).select("subject", "seq", "mid", "lower", "upper"))
query("g20_union", "SELECT subject, count(*) AS n FROM (SELECT event_type AS subject FROM events UNION ALL SELECT l_returnflag FROM lineitem) GROUP BY subject")(
    lambda s, d: event_samples(s, d).select("subject").unionByName(table(s, d, "lineitem").select(F.col("l_returnflag").alias("subject"))).groupBy("subject").agg(F.count("*").alias("n"))
)
query("g21_rates", f"WITH {SAMPLES}, x AS (SELECT subject, seq, t - lag(t) OVER w AS dt, hr - lag(hr) OVER w AS dh FROM samples WINDOW w AS (PARTITION BY subject ORDER BY t, seq)) SELECT subject, seq, round(dt, 6) AS dt, round(dh / dt, 6) AS rate FROM x WHERE dt > 0")(
    lambda s, d: timeagg.rates(event_samples(s, d), SUBJECT, ("t", "seq"), "hr").select("subject", "seq", "dt", "rate")
)
ACF = f"""WITH {nn_sql('subject')}, c AS (SELECT subject, i, rr - avg(rr) OVER (PARTITION BY subject) AS c FROM nn), v AS (SELECT subject, sum(c * c) AS v FROM c GROUP BY subject),
af AS (SELECT a.subject, lag, sum(a.c * b.c) / any_value(v) AS acf FROM range(41) AS r(lag), c a JOIN c b ON a.subject = b.subject AND b.i = a.i + lag JOIN v ON v.subject = a.subject GROUP BY a.subject, lag)"""
query("g22_acf", ACF + " SELECT subject, CAST(lag AS INT) AS lag, round(acf, 6) AS acf FROM af")(lambda s, d: timeagg.autocorrelation(beats(s, d, SUBJECT), SUBJECT, "rr"))
query("g22_pacf")(lambda s, d: timeagg.partial_autocorrelation(timeagg.autocorrelation(beats(s, d, SUBJECT), SUBJECT, "rr", lags=10), SUBJECT))
METRICS = ("mean_nni", "sdnn", "rmssd", "pnn50")
query("g24_metric_summary", f"WITH {nn_sql()}, {TIME.format(keys='subject, sol')}, u AS (UNPIVOT (SELECT mean_nni, sdnn, rmssd, CAST(pnn50 AS DOUBLE) AS pnn50 FROM tt) ON mean_nni, sdnn, rmssd, pnn50 INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM u GROUP BY metric")(
    lambda s, d: timeagg.unpivot(hrv.time_domain(beats(s, d)), ("subject", "sol"), METRICS).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
)
query("h28_grouping_sets", f"WITH {nn_sql()}, {TIME.format(keys='subject, sol')} SELECT subject, sol, round(avg(rmssd), 6) AS rmssd, round(avg(sdnn), 6) AS sdnn, count(*) AS n FROM tt GROUP BY GROUPING SETS ((), (subject), (sol))")(
    lambda s, d: hrv.time_domain(beats(s, d)).groupingSets([[], ["subject"], ["sol"]], "subject", "sol").agg(F.avg("rmssd").alias("rmssd"), F.avg("sdnn").alias("sdnn"), F.count("*").alias("n"))
)
_COMPLETE = f"WITH {nn_sql()}, {SPECTRUM.format(keys='subject, sol')}, {TIME.format(keys='subject, sol')}, {POINCARE.format(keys='subject, sol')}, ct AS (SELECT *, CASE WHEN sd1 > 0 THEN sd2 / sd1 ELSE 0 END AS sd1_sd2_ratio, pi() * sd1 * sd2 AS ellipse_area FROM tt JOIN fd USING (subject, sol) JOIN pc USING (subject, sol))"
_WHOLE = dict.fromkeys(c for c in (*hrv.TIME_DOMAIN, *FREQUENCY_COLUMNS, *hrv.TABLES["nonlinear"]))
_DIGITS = dict.fromkeys(FREQUENCY_COLUMNS, 4) | {"ellipse_area": 2}
for _name in (*hrv.TABLES, "complete"):
    query(f"h27_{_name}", f"{_COMPLETE} SELECT subject, sol, {', '.join(c if c in ('n', 'nn50', 'nn20') else f'round({c}, {_DIGITS.get(c, 6)}) AS {c}' for c in hrv.TABLES.get(_name, _WHOLE))} FROM ct")(
        lambda s, d, name=_name: (lambda t: t.withColumns({c: F.round(c, n) for c, n in _DIGITS.items() if c in t.columns}))(hrv.table_set(hrv.complete_table(beats(s, d)), name, digits=6))
    )
query("h27_table_set", f"WITH {nn_sql()}, {TIME.format(keys='subject, sol')} SELECT subject, sol, round(mean_nni, 2) AS mean_nni, round(sdnn, 2) AS sdnn, round(rmssd, 2) AS rmssd, round(pnn50, 2) AS pnn50 FROM tt")(lambda s, d: rounded(hrv.time_domain(beats(s, d)).select("subject", "sol", *METRICS), 2))
query(
    "h29_assess",
    f"""WITH {nn_sql()}, {TIME.format(keys='subject, sol')}, u AS (UNPIVOT (SELECT subject, sol, mean_nni, sdnn, rmssd, CAST(pnn50 AS DOUBLE) AS pnn50 FROM tt) ON mean_nni, sdnn, rmssd, pnn50 INTO NAME metric VALUE value),
ref(metric, p5, p25, p75, p95, risk) AS (VALUES ('sdnn', 25, 35, 50, 65, 20), ('rmssd', 20, 28, 48, 65, 15), ('pnn50', 3, 10, 26, 38, 3))
SELECT subject, sol, u.metric, round(value, 6) AS value, CASE WHEN p5 IS NULL THEN 'unknown' WHEN value < p5 THEN 'very_low' WHEN value < p25 THEN 'low' WHEN value <= p75 THEN 'normal' WHEN value <= p95 THEN 'high' ELSE 'very_high' END AS status,
CASE WHEN p5 IS NULL THEN false ELSE value >= p5 AND value >= p25 AND value <= p75 END AS within_normal, coalesce(value < risk, false) AS at_risk FROM u LEFT JOIN ref ON u.metric = ref.metric""",
)(lambda s, d: timeagg.assess(timeagg.unpivot(hrv.time_domain(beats(s, d)), ("subject", "sol"), METRICS)))

# J: joins

query("j1_merge_external", "SELECT l_suppkey, l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")(
    lambda s, d: align.merge_external(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), {"supplier": table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")}, ("l_suppkey",))
)
query("j1_match_rate", "SELECT count(*) AS n_rows, count(l.doc_id) AS n_matched, round(count(l.doc_id) / count(*), 6) AS match_rate FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")(lambda s, d: align.match_rate(table(s, d, "documents"), table(s, d, "labels"), ("doc_id",)))
SIGNAL = """{n} AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS t2, lead(v) OVER (ORDER BY t) AS v2 FROM (SELECT t, avg(hr) AS v FROM samples WHERE subject = '{s}' GROUP BY t)),
{n}g AS (SELECT g, v + (g / 0.01::DOUBLE - t) / (t2 - t) * (v2 - v) AS value FROM (SELECT *, unnest(generate_series(CAST(ceil(t * 0.01::DOUBLE) AS BIGINT), CAST(ceil(t2 * 0.01::DOUBLE) - 1 AS BIGINT))) AS g FROM {n} WHERE t2 > t))"""
query("j2_align", f"WITH {SAMPLES}, {SIGNAL.format(n='a', s='click')}, {SIGNAL.format(n='b', s='view')} SELECT ag.g, round(ag.g / 0.01::DOUBLE, 6) AS t, round(ag.value, 6) AS value_a, round(bg.value, 6) AS value_b FROM ag JOIN bg ON ag.g = bg.g")(
    lambda s, d: (lambda e: align.align(*[e.where(F.col("subject") == x).groupBy("t").agg(F.avg("hr").alias("value")) for x in ("click", "view")], 0.01))(event_samples(s, d))
)
PAIRS = f"{SAMPLES}, ps AS (SELECT subject, hr, row_number() OVER (PARTITION BY subject ORDER BY t, seq) AS position FROM samples), pr AS (SELECT a.position, a.hr AS x, b.hr AS y FROM ps a JOIN ps b ON a.position = b.position AND a.subject = 'click' AND b.subject = 'view')"
_pairs = lambda s, d: align.pair_by_position(event_samples(s, d), "subject", "hr", ("t", "seq"), "click", "view")
query("j3_pairs", f"WITH {PAIRS} SELECT position, round(x, 6) AS x, round(y, 6) AS y FROM pr")(lambda s, d: _pairs(s, d).withColumn("position", F.col("position").cast("long")))

# T: statistics. Long tables: metrics of lineitem by return flag.

LONG = "lg AS (SELECT metric, grp, value, id FROM (UNPIVOT (SELECT l_returnflag AS grp, l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount FROM lineitem) ON l_quantity, l_discount INTO NAME metric VALUE value))"


def _long(s, d):
    li = table(s, d, "lineitem").withColumns({"grp": F.col("l_returnflag"), "id": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    return timeagg.unpivot(li, ("grp", "id"), ("l_quantity", "l_discount"))


QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, **{f"p{p}": p / 100 for p in stats.PERCENTILES}}
SKEW = "avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5)"
query(
    "t1_describe",
    f"""WITH {LONG}, c AS (SELECT *, avg(value) OVER (PARTITION BY metric, grp) AS m FROM lg), g AS (SELECT metric, grp, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS variance, min(value) AS mi, max(value) AS ma, {SKEW} AS skew, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS kurtosis,
{', '.join(f'quantile_cont(value, {q}) AS {n}' for n, q in QUANTILES.items())} FROM c GROUP BY metric, grp),
x AS (SELECT metric, grp, quantile_cont(abs(value - median), 0.5) AS mad, count(*) FILTER (NOT value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers FROM lg JOIN g USING (metric, grp) GROUP BY metric, grp)
SELECT metric, grp, n, {r6('mean', 'std', 'variance', 'skew', 'kurtosis', *QUANTILES, 'mad')}, round(q1 - 1.5::DOUBLE * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS upper_bound, round(mi, 6) AS min, round(ma, 6) AS max, n_outliers, round(std / mean, 6) AS cv, round(ma - mi, 6) AS value_range, round(q3 - q1, 6) AS iqr FROM g JOIN x USING (metric, grp)""",
)(lambda s, d: stats.describe(_long(s, d)))
query("t1_mode", f"WITH {LONG}, c AS (SELECT metric, grp, value, count(*) AS c FROM lg GROUP BY ALL) SELECT metric, grp, round(value, 6) AS mode, c AS n FROM c QUALIFY row_number() OVER (PARTITION BY metric, grp ORDER BY c DESC, value) = 1")(lambda s, d: stats.mode(_long(s, d)))
query(
    "t2_jarque_bera",
    f"WITH {LONG}, c AS (SELECT *, avg(value) OVER (PARTITION BY metric, grp) AS m FROM lg), g AS (SELECT metric, grp, count(value) AS n, {SKEW} AS skew, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS kurtosis FROM c GROUP BY metric, grp) SELECT metric, grp, n, {r6('skew', 'kurtosis')}, round(n / 6 * (skew * skew + kurtosis * kurtosis / 4), 5) AS jb FROM g",
)(lambda s, d: stats.jarque_bera(_long(s, d)).drop("p_value").withColumn("jb", F.round("jb", 5)))
TWO = f"""WITH {LONG}, m AS (SELECT metric, count(value) FILTER (grp = 'A') AS na, avg(value) FILTER (grp = 'A') AS ma, var_samp(value) FILTER (grp = 'A') AS va, count(value) FILTER (grp = 'R') AS nb, avg(value) FILTER (grp = 'R') AS mb, var_samp(value) FILTER (grp = 'R') AS vb FROM lg GROUP BY metric)"""
query("t4_welch_t", TWO + " SELECT metric, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df, round(ma - mb, 6) AS difference, round(sqrt(va / na + vb / nb), 6) AS se FROM m")(lambda s, d: stats.t_test(_long(s, d), "A", "R").drop("p_value", "low", "high").withColumn("df", F.round("df", 4)))
query("t4_student_t", TWO + " SELECT metric, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t, CAST(na + nb - 2 AS DOUBLE) AS df, round(ma - mb, 6) AS difference, round(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS se FROM m")(lambda s, d: stats.t_test(_long(s, d), "A", "R", True).drop("p_value", "low", "high"))
query("t4_mean_difference")(lambda s, d: stats.t_test(_long(s, d), "A", "R"))
COUNTS = f"WITH {LONG}, vc AS (SELECT metric, value, count(*) FILTER (grp = 'A') AS ca, count(*) FILTER (grp = 'R') AS cb FROM lg WHERE grp IN ('A', 'R') GROUP BY metric, value)"
query(
    "t5_mann_whitney",
    COUNTS + """, rk AS (SELECT *, coalesce(sum(ca + cb) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ca + cb + 1) / 2 AS r FROM vc), s AS (SELECT metric, sum(ca)::DOUBLE AS na, sum(cb)::DOUBLE AS nb, sum(ca * r) AS ra, sum(pow(ca + cb, 3) - (ca + cb)) AS ties FROM rk GROUP BY metric),
u AS (SELECT *, ra - na * (na + 1) / 2 AS u, na + nb AS n FROM s) SELECT metric, round(u, 6) AS u, round(2 * u / (na * nb) - 1, 6) AS rank_biserial, round((u - na * nb / 2) / sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""",
)(lambda s, d: stats.mann_whitney(_long(s, d), "A", "R").drop("p_value"))
query("t6_wilcoxon", f"WITH {PAIRS}, df AS (SELECT round(x - y, 9) AS d FROM pr WHERE round(x - y, 9) <> 0), rk AS (SELECT d, (rank() OVER (ORDER BY abs(d)) * 2 + count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM df) SELECT 'hr' AS metric, count(*) AS n, round(sum(r) FILTER (d > 0), 6) AS w_plus, round(sum(r) FILTER (d < 0), 6) AS w_minus FROM rk")(
    lambda s, d: stats.wilcoxon(_pairs(s, d).withColumn("metric", F.lit("hr"))).drop("z", "p_value")
)
query("t7_ks", COUNTS + """, g AS (SELECT metric, abs(sum(ca) OVER w / sum(ca) OVER a - sum(cb) OVER w / sum(cb) OVER a) AS gap, sum(ca) OVER a AS na, sum(cb) OVER a AS nb FROM vc WINDOW w AS (PARTITION BY metric ORDER BY value), a AS (PARTITION BY metric)), k AS (SELECT metric, max(gap) AS d, max(gap) * sqrt(max(na * nb / (na + nb))) AS x FROM g GROUP BY metric)
SELECT metric, round(d, 6) AS d, round(CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * x * x)) FROM range(1, 101) AS q(j)))) END, 6) AS p_value FROM k""")(lambda s, d: stats.ks_two_sample(_long(s, d), "A", "R"))
ANOVA = """gm AS (SELECT metric, grp, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM {src} GROUP BY metric, grp), gg AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS grand, n / v AS wt, sum(n / v) OVER w AS sw, sum(n / v * m) OVER w / sum(n / v) OVER w AS centre FROM gm WINDOW w AS (PARTITION BY metric)),
an AS (SELECT metric, count(*) AS k, sum(n)::DOUBLE AS n, sum(n * pow(m - grand, 2)) AS b, sum((n - 1) * v) AS wi, sum(wt * pow(m - centre, 2)) AS wb, sum(pow(1 - wt / sw, 2) / (n - 1)) AS lam FROM gg GROUP BY metric),
av AS (SELECT metric, b / (k - 1) / (wi / (n - k)) AS f, CAST(k - 1 AS DOUBLE) AS df1, n - k AS df2, b / (b + wi) AS eta_squared, wb / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam) AS welch_f, (k * k - 1) / (3 * lam) AS welch_df2 FROM an)"""
query("t8_levene", f"WITH {LONG}, md AS (SELECT metric, grp, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY metric, grp)) AS value FROM lg), {ANOVA.format(src='md')} SELECT metric, round(f, 6) AS w, df1, df2 FROM av")(lambda s, d: stats.levene(_long(s, d)).drop("p_value"))
query("t9_anova", f"WITH {LONG}, {ANOVA.format(src='lg')} SELECT metric, round(f, 6) AS f, df1, df2, round(eta_squared, 8) AS eta_squared, round(welch_f, 6) AS welch_f, round(welch_df2, 4) AS welch_df2 FROM av")(
    lambda s, d: stats.anova(_long(s, d)).drop("p_value", "welch_p").select("metric", "f", "df1", "df2", F.round("eta_squared", 8).alias("eta_squared"), "welch_f", F.round("welch_df2", 4).alias("welch_df2"))
)
RANKS = """rk AS (SELECT metric, grp, (rank() OVER (PARTITION BY metric ORDER BY value) * 2 + count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY metric, value) AS c FROM lg), rs AS (SELECT metric, grp, count(*)::DOUBLE AS n, sum(r) AS rank_sum, sum(c * c - 1) AS tt FROM rk GROUP BY metric, grp),
tie AS (SELECT metric, sum(tt)::DOUBLE AS ties, sum(n) AS total FROM rs GROUP BY metric)"""
query("t9_kruskal", f"WITH {LONG}, {RANKS}, h AS (SELECT metric, count(*) AS k, any_value(total) AS n, (12 / (any_value(total) * (any_value(total) + 1)) * sum(rank_sum * rank_sum / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (pow(any_value(total), 3) - any_value(total))) AS h FROM rs JOIN tie USING (metric) GROUP BY metric) SELECT metric, round(h, 5) AS h, CAST(k - 1 AS DOUBLE) AS df, round((h - k + 1) / (n - k), 6) AS epsilon_squared FROM h")(
    lambda s, d: stats.kruskal(_long(s, d)).drop("p_value").withColumn("h", F.round("h", 5))
)
query("t10_friedman", f"WITH {SAMPLES}, ps AS (SELECT subject, hr, row_number() OVER (PARTITION BY subject ORDER BY t, seq) AS block FROM samples), fb AS (SELECT block, subject, hr FROM ps QUALIFY count(*) OVER (PARTITION BY block) = 5), fr AS (SELECT subject, block, (rank() OVER (PARTITION BY block ORDER BY hr) * 2 + count(*) OVER (PARTITION BY block, hr) - 1) / 2 AS r FROM fb), fs AS (SELECT subject, sum(r) AS r, count(*)::DOUBLE AS n FROM fr GROUP BY subject), fq AS (SELECT count(*) AS k, max(n) AS n, 12 / (max(n) * count(*) * (count(*) + 1)) * sum(r * r) - 3 * max(n) * (count(*) + 1) AS chi2 FROM fs) SELECT 'hr' AS metric, round(chi2, 6) AS chi2, round(chi2 / (n * (k - 1)), 6) AS kendall_w FROM fq")(
    lambda s, d: stats.friedman(numbered(event_samples(s, d), SUBJECT, ("t", "seq"), "block").select(F.lit("hr").alias("metric"), F.col("subject").alias("grp"), F.col("hr").alias("value"), "block").withColumn("c", F.count("*").over(Window.partitionBy("block"))).where("c = 5").drop("c")).drop("p_value")
)
query("t12_pairwise", f"WITH {LONG}, gm AS (SELECT metric, grp, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM lg GROUP BY metric, grp) SELECT a.metric, a.grp AS a, b.grp AS b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1 - 3 / (4 * (a.n + b.n) - 9)), 6) AS hedges_g FROM gm a JOIN gm b ON a.metric = b.metric AND a.grp < b.grp")(
    lambda s, d: stats.pairwise(_long(s, d)).drop("p_value", "p_bonferroni", "p_bh").withColumn("df", F.round("df", 4))
)
query("t12_dunn", f"WITH {LONG}, {RANKS} SELECT a.metric, a.grp AS a, b.grp AS b, round((a.rank_sum / a.n - b.rank_sum / b.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1 / a.n + 1 / b.n)), 6) AS z FROM rs a JOIN rs b ON a.metric = b.metric AND a.grp < b.grp JOIN tie ON tie.metric = a.metric")(
    lambda s, d: stats.dunn(_long(s, d)).select("metric", "a", "b", "z")
)
query("t13_adjusted_p")(lambda s, d: stats.pairwise(_long(s, d)))
query(
    "t14_effect_sizes",
    COUNTS + TWO.removeprefix(f"WITH {LONG}") + """, cl AS (SELECT metric, sum(ca * (below + cb / 2)) AS wins FROM (SELECT *, coalesce(sum(cb) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vc) GROUP BY metric),
e AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS dd FROM m JOIN cl USING (metric))
SELECT metric, round(dd, 6) AS cohen_d, round(dd * (1 - 3 / (4 * (na + nb) - 9)), 6) AS hedges_g, round((ma - mb) / sqrt(vb), 6) AS glass_delta, round(100 * (ma - mb) / mb, 6) AS percent_difference, round(dd / sqrt(dd * dd + (na + nb) * (na + nb) / (na * nb)), 6) AS point_biserial, round(wins / (na * nb), 6) AS cles FROM e""",
)(lambda s, d: stats.effect_sizes(_long(s, d), "A", "R"))
query("t15_labels")(lambda s, d: stats.pairwise(_long(s, d)).select("metric", "a", "b", stats.magnitude(F.col("hedges_g")).alias("effect"), stats.stars(F.col("p_value")).alias("stars")))
query("t16_bootstrap")(lambda s, d: stats.bootstrap_means(_long(s, d), reps=1000))
query("t17_bootstrap_quantiles")(lambda s, d: stats.bootstrap_quantiles(_long(s, d), (0.25, 0.5, 0.75), reps=1000))
query("t18_permutation")(lambda s, d: stats.permutation(_long(s, d), "A", "R", reps=10_000))
COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
query("t19_pearson", "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for k, a in enumerate(COLS) for b in COLS[k + 1 :]))(lambda s, d: stats.correlations(table(s, d, "lineitem"), list(COLS)).drop("p_value"))
_FIVE = ("mean_nni", "sdnn", "rmssd", "pnn50", "mean_hr")
_PAIRS = [(a, b) for k, a in enumerate(_FIVE) for b in _FIVE[k + 1 :]]
query(
    "g19_strongest_correlations",
    f"WITH {nn_sql()}, {TIME.format(keys='subject, sol')}, r AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM tt" for a, b in _PAIRS)}) SELECT a, b, n, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM r WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, a, b LIMIT 10",
)(lambda s, d: stats.strongest(stats.correlations(hrv.time_domain(beats(s, d)), list(_FIVE)), 10, 0.3).drop("p_value"))
query(
    "t19_ordered_matrix",
    f"""WITH h AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for k, a in enumerate(COLS[:3]) for b in COLS[:3][k + 1 :])}), best AS (SELECT a, b FROM h ORDER BY 1 - abs(r) LIMIT 1), m AS (SELECT unnest({list(COLS[:3])!r}) AS m),
pl AS (SELECT m, CASE WHEN m = a THEN 1 WHEN m = b THEN 2 ELSE 0 END AS place FROM m, best), f AS (SELECT a, b, r FROM h UNION ALL SELECT b, a, r FROM h UNION ALL SELECT m, m, 1 FROM m)
SELECT f.a, f.b, round(r, 6) AS r, x.place AS a_at, y.place AS b_at FROM f JOIN pl x ON x.m = f.a JOIN pl y ON y.m = f.b""",
)(lambda s, d: stats.ordered_matrix(table(s, d, "lineitem"), list(COLS[:3])).drop("p_value"))
query("t19_spearman", "WITH r AS (SELECT (rank() OVER (ORDER BY o_totalprice) * 2 + count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS x, (rank() OVER (ORDER BY o_custkey) * 2 + count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS y FROM orders) SELECT 'o_totalprice' AS a, 'o_custkey' AS b, count(*) AS n, round(corr(x, y), 6) AS r FROM r")(
    lambda s, d: stats.correlations(stats.ranked(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], ["o_orderkey"]), ["o_totalprice", "o_custkey"]).drop("p_value")
)
query("t20_t24_regression", f"WITH {SAMPLES} SELECT subject, round(regr_slope(hr, t), 9) AS slope, round(regr_intercept(hr, t), 4) AS intercept, round(regr_r2(hr, t), 8) AS r2, regr_count(hr, t)::BIGINT AS n FROM samples GROUP BY subject")(
    lambda s, d: stats.regression(event_samples(s, d), ["subject"], "hr", "t").select("subject", (F.round(F.col("slope") * 1e6, 3) / 1e6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), "n")
)
SERIES = "sr AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS y FROM orders GROUP BY ALL), si AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY m) - 1 AS i, y FROM sr)"


def series(s, d):
    """Monthly mean order price per priority: series_id, i from 0, y."""
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("y"))
    return o.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("m")) - 1).cast("long").alias("i"), "y")


query(
    "t26_decompose",
    f"""WITH {SERIES}, ft AS (SELECT series_id, regr_slope(y, i) AS b, regr_intercept(y, i) AS a, count(*) AS n FROM si GROUP BY series_id HAVING count(*) >= 4), r AS (SELECT si.series_id, i, y, a + b * i AS trend, y - a - b * i AS rest, n FROM si JOIN ft USING (series_id)),
z AS (SELECT *, CASE WHEN n >= 8 THEN avg(rest) OVER (PARTITION BY series_id, i % 4) - avg(rest) OVER (PARTITION BY series_id) ELSE 0 END AS seasonal FROM r) SELECT series_id, i, round(y, 3) AS y, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(rest - seasonal, 3) AS residual FROM z""",
)(lambda s, d: rounded(stats.decompose(series(s, d)), 3))
query("t23_icc", f"WITH {LONG}, {ANOVA.format(src='lg')}, n0 AS (SELECT metric, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM gm GROUP BY metric), q AS (SELECT metric, wi / (n - k) AS w, greatest(0, (b / (k - 1) - wi / (n - k)) / n0) AS bv FROM an JOIN n0 USING (metric)) SELECT metric, round(bv, 6) AS between_variance, round(w, 6) AS within_variance, round(bv / (bv + w), 6) AS icc FROM q")(lambda s, d: stats.intraclass(_long(s, d)))
