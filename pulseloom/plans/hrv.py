"""Cleaning, beats and heart-rate variability over the event table, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from pulseloom.functions.columns import rounded
from pulseloom.operators import clean, hrv, rr
from pulseloom.plans.base import SAMPLES, SUBJECT, beats, nn_sql, rr_sql
from pulseloom.sources.samples import event_samples, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# F: cleaning and quality

query("f2_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT (user_id, event_type)) AS n_distinct, count(*) - count(DISTINCT (user_id, event_type)) AS n_duplicates FROM events")(
    lambda s, d: clean.duplicate_count(table(s, d, "events").select("user_id", "event_type"))
)
query("f3_numeric", "SELECT event_type, count(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS n_numeric, round(sum(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)), 6) AS total, count(TRY_CAST(props AS DOUBLE)) AS n_raw FROM events GROUP BY event_type")(
    lambda s, d: table(s, d, "events").withColumn("x", clean.numeric(F.regexp_extract("props", "[0-9]+", 0))).groupBy("event_type").agg(F.count("x").alias("n_numeric"), F.sum("x").alias("total"), F.count(clean.numeric(F.col("props"))).alias("n_raw"))
)
query("f4_range_null", f"WITH {SAMPLES} SELECT subject, sol, count(*) AS n, count(CASE WHEN hr BETWEEN 30 AND 220 THEN hr END) AS n_valid, round(avg(CASE WHEN hr BETWEEN 30 AND 220 THEN hr END), 6) AS mean_hr FROM samples GROUP BY subject, sol")(
    lambda s, d: event_samples(s, d).withColumn("v", clean.range_null(F.col("hr"))).groupBy("subject", "sol").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.avg("v").alias("mean_hr"))
)

STAGED = f"""WITH {SAMPLES},
holed AS (SELECT subject, sol, t, seq, CASE WHEN seq % 7 <> 0 THEN hr END AS hr FROM samples),
r AS (SELECT *, CASE WHEN hr BETWEEN 30 AND 220 THEN hr END AS v FROM holed),
m AS (SELECT subject, sol, quantile_cont(v, 0.5) AS med, count(v) AS n FROM r GROUP BY subject, sol),
a AS (SELECT subject, sol, quantile_cont(abs(v - med), 0.5) AS mad FROM r JOIN m USING (subject, sol) GROUP BY subject, sol),
z AS (SELECT r.*, coalesce(v IS NOT NULL AND CASE WHEN n > 10 AND mad > 0 THEN abs(0.6745::DOUBLE * (v - med) / mad) <= 4 ELSE true END, false) AS third FROM r JOIN m USING (subject, sol) JOIN a USING (subject, sol)),
g AS (SELECT *, coalesce(third AND t - lag(t) OVER w > 0 AND abs((hr - lag(hr) OVER w) / (t - lag(t) OVER w)) <= 5, false) AS steady FROM z WINDOW w AS (PARTITION BY subject, sol, third ORDER BY t, seq)),
b AS (SELECT *, max(steady::INT) OVER (PARTITION BY subject, sol) AS any_steady FROM g),
st AS (SELECT *, CASE WHEN hr IS NULL THEN 0 WHEN v IS NULL THEN 1 WHEN NOT third THEN 2 WHEN any_steady = 1 AND NOT steady THEN 3 ELSE 4 END AS stage FROM b)"""


def _holed(s, d):
    return event_samples(s, d).withColumn("hr", F.when(F.col("seq") % 7 != 0, F.col("hr")))


query("f5_quality_stages", STAGED + " SELECT subject, sol, count(*) AS n_total, count(*) FILTER (stage >= 1) AS n_present, count(*) FILTER (stage >= 2) AS n_in_range, count(*) FILTER (stage >= 3) AS n_typical, count(*) FILTER (stage >= 4) AS n_steady FROM st GROUP BY subject, sol")(
    lambda s, d: clean.stage_counts(clean.quality_pipeline(_holed(s, d)))
)

RECORD = f"""WITH {SAMPLES},
v AS (SELECT subject, sol, t, CASE WHEN seq % 7 <> 0 AND hr BETWEEN 30 AND 220 THEN hr END AS v FROM samples),
q AS (SELECT subject, sol, count(*) AS n_total, count(v) AS n_valid, avg(v) AS mean_hr, stddev_samp(v) AS std_hr, min(v) AS min_hr, max(v) AS max_hr, quantile_cont(v, 0.1) AS resting_hr, quantile_cont(v, 0.95) AS q95,
 quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, (max(t) - min(t)) / 3600 AS coverage_hours FROM v GROUP BY subject, sol),
o AS (SELECT subject, sol, count(*) FILTER (v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_out FROM v JOIN q USING (subject, sol) GROUP BY subject, sol),
rec AS (SELECT subject, sol, n_total, n_valid, n_valid / n_total AS valid_ratio, 1 - n_valid / n_total AS missing_ratio, CASE WHEN n_valid > 4 THEN n_out / n_valid ELSE 0 END AS outlier_ratio, mean_hr, std_hr, min_hr, max_hr, coverage_hours, resting_hr,
 (q95 - resting_hr) / resting_hr AS hr_reserve, CASE WHEN n_valid / n_total >= 0.8 THEN 'EXCELLENT' WHEN n_valid / n_total >= 0.7 THEN 'GOOD' WHEN n_valid / n_total >= 0.6 THEN 'FAIR' ELSE 'POOR' END AS status FROM q JOIN o USING (subject, sol))"""
RECORD_COLUMNS = ("valid_ratio", "missing_ratio", "outlier_ratio", "mean_hr", "std_hr", "min_hr", "max_hr", "coverage_hours", "resting_hr", "hr_reserve")
query("f6_quality_record", RECORD + f" SELECT subject, sol, n_total, n_valid, {r6(*RECORD_COLUMNS)}, status FROM rec")(lambda s, d: clean.quality_record(_holed(s, d)))
query(
    "f7_quality_report",
    RECORD
    + """ SELECT subject, sol, valid_ratio >= 0.8 AS passes, array_to_string(list_filter([CASE WHEN valid_ratio < 0.8 THEN 'improve signal quality' END, CASE WHEN missing_ratio > 0.2 THEN 'check sensor contact' END,
CASE WHEN outlier_ratio > 0.05 THEN 'remove outliers' END, CASE WHEN coverage_hours < 1 THEN 'record longer' END, CASE WHEN std_hr < 2 THEN 'check for a stuck sensor' END], lambda x: x IS NOT NULL), ';') AS recommendations FROM rec""",
)(lambda s, d: clean.quality_report(clean.quality_record(_holed(s, d))).select("subject", "sol", "passes", "recommendations"))
query(
    "f8_column_summary",
    "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, round(100 * avg(({c} IS NULL)::INT), 6) AS missing_percent, 0::BIGINT AS n_infinite, count(*) FILTER (abs({c}) > 1e6) AS n_huge FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)(lambda s, d: clean.column_summary(table(s, d, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
query("f9_missing_rate", f"WITH {SAMPLES} SELECT subject, sol, round(100 * avg((seq % 7 = 0)::INT), 6) AS missing_percent, 100 * avg((seq % 7 = 0)::INT) > 50 AS flagged FROM samples GROUP BY subject, sol")(lambda s, d: clean.missing_rate(_holed(s, d)))
query(
    "f10_sigma_clip",
    f"""WITH {SAMPLES}, u AS (SELECT * FROM samples WHERE hr > 0), b AS (SELECT subject, sol, greatest(30, avg(hr) - 4 * stddev_samp(hr)) AS lo, least(200, avg(hr) + 4 * stddev_samp(hr)) AS hi FROM u GROUP BY subject, sol)
SELECT subject, sol, count(*) AS n, round(sum(hr), 4) AS total_hr, round(max(hr), 6) AS max_hr FROM u JOIN b USING (subject, sol) WHERE hr BETWEEN lo AND hi GROUP BY subject, sol HAVING count(*) >= 50""",
)(lambda s, d: clean.sigma_clip(event_samples(s, d)).groupBy("subject", "sol").agg(F.count("*").alias("n"), F.round(F.sum("hr"), 4).alias("total_hr"), F.max("hr").alias("max_hr")))
query("f11_mean_fill", f"WITH {SAMPLES} SELECT subject, seq, round(coalesce(CASE WHEN seq % 7 <> 0 THEN hr END, avg(CASE WHEN seq % 7 <> 0 THEN hr END) OVER (PARTITION BY subject)), 6) AS hr FROM samples")(
    lambda s, d: clean.mean_fill(_holed(s, d), "hr", SUBJECT).select("subject", "seq", "hr")
)
query(
    "f13_interpolate",
    f"""WITH {SAMPLES}, h AS (SELECT subject, sol, t, seq, CASE WHEN seq % 7 <> 0 THEN hr END AS hr, CASE WHEN seq % 7 <> 0 THEN t END AS k FROM samples),
w AS (SELECT *, last_value(hr IGNORE NULLS) OVER b AS ph, last_value(k IGNORE NULLS) OVER b AS pt, first_value(hr IGNORE NULLS) OVER a AS fh, first_value(k IGNORE NULLS) OVER a AS ft FROM h
WINDOW b AS (PARTITION BY subject, sol ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY subject, sol ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT subject, sol, seq, round(coalesce(hr, CASE WHEN ft > pt THEN ph + (t - pt) / (ft - pt) * (fh - ph) END, ph, fh), 6) AS filled FROM w""",
)(lambda s, d: clean.interpolate(_holed(s, d)).select("subject", "sol", "seq", "filled"))
query("f14_subjects", "SELECT DISTINCT event_type AS subject FROM events")(lambda s, d: event_samples(s, d).select("subject").distinct())
query(
    "f15_intervals",
    f"""WITH {SAMPLES}, x AS (SELECT subject, t - lag(t) OVER (PARTITION BY subject ORDER BY t, seq) AS dt FROM samples), y AS (SELECT * FROM x WHERE dt IS NOT NULL),
g AS (SELECT subject, count(*) AS n, avg(dt) AS mean_dt, quantile_cont(dt, 0.5) AS median_dt, quantile_cont(dt, 0.99) AS p99_dt FROM y GROUP BY subject)
SELECT subject, n, {r6("mean_dt", "median_dt", "p99_dt")}, (SELECT round(max(dt), 6) FROM y WHERE y.subject = g.subject AND dt <= g.p99_dt) AS longest_usual FROM g""",
)(lambda s, d: clean.interval_stats(event_samples(s, d)))
query("f16_complete_cases", "SELECT count(*) AS n_rows, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS n_complete, round(100 * avg((quality IS NULL)::INT), 6) AS missing_percent FROM documents LEFT JOIN labels USING (doc_id)")(
    lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").agg(F.count("*").alias("n_rows"), F.count_if(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("n_complete"), (100 * F.avg(F.col("quality").isNull().cast("double"))).alias("missing_percent"))
)
for _how, _base, _spread in (("minmax", "min(hr) OVER w", "max(hr) OVER w - min(hr) OVER w"), ("zscore", "avg(hr) OVER w", "stddev_samp(hr) OVER w"), ("robust", "quantile_cont(hr, 0.5) OVER w", "quantile_cont(hr, 0.75) OVER w - quantile_cont(hr, 0.25) OVER w")):
    query(f"f17_normalise_{_how}", f"WITH {SAMPLES}, n AS (SELECT subject, seq, hr, {_base} AS b, {_spread} AS s FROM samples WINDOW w AS (PARTITION BY subject)) SELECT subject, seq, round(CASE WHEN s > 0 THEN (hr - b) / s ELSE 0 END, 6) AS normal FROM n")(
        lambda s, d, how=_how: clean.normalise(event_samples(s, d), "hr", SUBJECT, how).select("subject", "seq", "normal")
    )
query("f18_relative_time", f"WITH {SAMPLES} SELECT subject, seq, round((t - min(t) OVER (PARTITION BY subject)) / 3600, 6) AS elapsed FROM samples")(lambda s, d: clean.relative_time(event_samples(s, d), SUBJECT).select("subject", "seq", "elapsed"))

# R: beats

query("r1_compute_rr", f"WITH {rr_sql()} SELECT subject, sol, i, round(rr, 6) AS rr FROM rr")(lambda s, d: rr.compute_rr(event_samples(s, d)).select("subject", "sol", F.col("i").cast("long").alias("i"), "rr"))
query(
    "r2_conversion_info",
    f"""WITH {SAMPLES}, v AS (SELECT subject, sol, CASE WHEN hr > 0 AND 60000::DOUBLE / hr BETWEEN 300 AND 2000 THEN hr END AS v FROM samples)
SELECT subject, sol, count(*) AS n_in, count(v) AS n_valid, count(*) - count(v) AS n_filtered, round(avg(v), 6) AS mean_hr, round(stddev_samp(v), 6) AS std_hr, round(min(v), 6) AS min_hr, round(max(v), 6) AS max_hr FROM v GROUP BY subject, sol""",
)(lambda s, d: rr.conversion_info(event_samples(s, d)))

_FLAGS = {
    "malik": "coalesce(n >= 10 AND abs(rr - p) / p > 0.2 AND abs(rr - q) / q > 0.2, false)",
    "kamath": "coalesce(n >= 10 AND abs(rr - p) > 200 AND abs(rr - p) / p > 0.25, false)",
    "iqr": "n >= 10 AND (rr < q1 - 1.5::DOUBLE * (q3 - q1) OR rr > q3 + 1.5::DOUBLE * (q3 - q1))",
    "zscore": "n >= 10 AND CASE WHEN sd > 0 THEN abs(rr - mean) / sd > 3 ELSE false END",
    "karlsson": "coalesce(n >= 10 AND len(five) = 5 AND abs(rr - list_sort(five)[3]) > greatest(0.15::DOUBLE * list_sort(five)[3], 3 * list_sort(list_transform(five, lambda x: abs(x - list_sort(five)[3])))[3]), false)",
}
_NEAR = f"""WITH {rr_sql()}, near AS (SELECT *, lag(rr) OVER w AS p, lead(rr) OVER w AS q, count(*) OVER v AS n, avg(rr) OVER v AS mean, stddev_pop(rr) OVER v AS sd, quantile_cont(rr, 0.25) OVER v AS q1, quantile_cont(rr, 0.75) OVER v AS q3,
list(rr) OVER (PARTITION BY subject, sol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS five FROM rr WINDOW w AS (PARTITION BY subject, sol ORDER BY i), v AS (PARTITION BY subject, sol)),
f AS (SELECT *, {{flag}} AS artifact FROM near)"""
for _number, _method in (("r3", "malik"), ("r4", "karlsson"), ("r5", "kamath"), ("r6", "iqr"), ("r7", "zscore")):
    query(f"{_number}_{_method}", _NEAR.format(flag=_FLAGS[_method]) + " SELECT subject, sol, count(*) AS n_beats, count(*) FILTER (artifact) AS n_artifacts, round(count(*) FILTER (artifact) / count(*), 6) AS artifact_ratio FROM f GROUP BY subject, sol")(
        lambda s, d, m=_method: rr.artifact_ratio(rr.DETECTORS[m](rr.compute_rr(event_samples(s, d))))
    )
query("r8_clean_rr", f"WITH {nn_sql()} SELECT subject, sol, count(*) AS n, round(sum(rr), 6) AS total FROM nn GROUP BY subject, sol")(
    lambda s, d: rr.clean_rr(rr.compute_rr(event_samples(s, d)), "acar").groupBy("subject", "sol").agg(F.count("*").alias("n"), F.sum("rr").alias("total"))
)

GRID = """tb AS (SELECT {keys}, i, rr, (sum(rr) OVER (PARTITION BY {keys} ORDER BY i) - rr) / 1000 AS t, count(*) OVER (PARTITION BY {keys}) - 1 AS n FROM nn),
tl AS (SELECT *, lead(t) OVER w AS t2, lead(rr) OVER w AS x2 FROM tb WHERE i <= n WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
ge AS (SELECT *, unnest(generate_series(CAST(ceil(t * 4) AS BIGINT), CAST(CASE WHEN i = n - 1 THEN floor(t2 * 4) ELSE ceil(t2 * 4) - 1 END AS BIGINT))) AS g FROM tl WHERE t2 IS NOT NULL)"""
query("r9_resample", f"WITH {nn_sql()}, {GRID.format(keys='subject, sol')} SELECT subject, sol, g, round(rr + (g / 4.0::DOUBLE - t) / (t2 - t) * (x2 - rr), 4) AS x FROM ge")(
    lambda s, d: rounded(rr.resample(beats(s, d)), 4)
)
query(
    "r10_savgol",
    f"""WITH {nn_sql()} SELECT subject, sol, i, round((-3 * lag(rr, 2) OVER w + 12 * lag(rr) OVER w + 17 * rr + 12 * lead(rr) OVER w - 3 * lead(rr, 2) OVER w) / 35, 6) AS smooth FROM nn WINDOW w AS (PARTITION BY subject, sol ORDER BY i)""",
)(lambda s, d: rr.smooth(beats(s, d)).select("subject", "sol", F.col("i").cast("long").alias("i"), "smooth"))
query(
    "r10_median",
    f"""WITH {nn_sql()}, l AS (SELECT *, list(rr) OVER (PARTITION BY subject, sol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS five FROM nn) SELECT subject, sol, i, round(CASE WHEN len(five) = 5 THEN list_sort(five)[3] END, 6) AS smooth FROM l""",
)(lambda s, d: rr.smooth(beats(s, d), "median").select("subject", "sol", F.col("i").cast("long").alias("i"), "smooth"))
QUALITY = f"""WITH {nn_sql()}, q AS (SELECT subject, sol, count(*) AS n_beats, avg(rr) AS mean_rr, stddev_pop(rr) AS sd_rr, coalesce(sqrt(avg(d * d)), 0) AS rmssd, count(*) FILTER (abs(d) > 50) AS nn50 FROM dd GROUP BY subject, sol),
z AS (SELECT *, CASE WHEN n_beats > 1 THEN 100 * nn50 / (n_beats - 1) ELSE 0 END AS pnn50, (least(1, n_beats / 100) + least(1, sd_rr / mean_rr / 0.1::DOUBLE) + least(1, rmssd / 30)) / 3 AS score FROM q)"""
query(
    "r11_signal_quality",
    QUALITY + f" SELECT subject, sol, n_beats, nn50, {r6('mean_rr', 'sd_rr', 'rmssd', 'pnn50', 'score')}, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' WHEN score >= 0.2 THEN 'poor' ELSE 'very_poor' END AS label FROM z",
)(lambda s, d: rr.signal_quality(beats(s, d)))

# H: variability

TIME = """td AS (SELECT {keys}, count(*) AS n, avg(rr) AS mean_nni, coalesce(stddev_samp(rr), 0) AS sdnn, quantile_cont(rr, 0.5) AS median_nni, coalesce(sqrt(avg(d * d)), 0) AS rmssd, count(*) FILTER (abs(d) > 50) AS nn50, count(*) FILTER (abs(d) > 20) AS nn20,
 coalesce(stddev_samp(d), 0) AS sdsd, avg(abs(d)) AS mad_d, avg(60000 / rr) AS mean_hr, coalesce(stddev_samp(60000 / rr), 0) AS std_hr, min(60000 / rr) AS min_hr, max(60000 / rr) AS max_hr FROM dd GROUP BY {keys}),
mads AS (SELECT {keys}, quantile_cont(abs(rr - median_nni), 0.5) AS mad_nni FROM nn JOIN td USING ({keys}) GROUP BY {keys}),
tt AS (SELECT {keys}, n, mean_nni, sdnn, rmssd, nn50, CASE WHEN n > 1 THEN 100 * nn50 / (n - 1) ELSE 0 END AS pnn50, nn20, CASE WHEN n > 1 THEN 100 * nn20 / (n - 1) ELSE 0 END AS pnn20, sdsd, CASE WHEN mad_d > 0 THEN sdsd * 100 / mad_d ELSE 0 END AS cvsd,
 sdnn / mean_nni * 100 AS cvnn, mad_nni / median_nni * 100 AS mcv_nni, median_nni, mad_nni, mean_hr, std_hr, min_hr, max_hr FROM td JOIN mads USING ({keys}))"""
TIME_COLUMNS = ("mean_nni", "sdnn", "rmssd", "pnn50", "pnn20", "sdsd", "cvsd", "cvnn", "mcv_nni", "median_nni", "mad_nni", "mean_hr", "std_hr", "min_hr", "max_hr")
SEG = "subject, sol"
query("h2_h3_time_domain", f"WITH {nn_sql()}, {TIME.format(keys=SEG)} SELECT subject, sol, n, nn50, nn20, {r6(*TIME_COLUMNS)} FROM tt")(lambda s, d: hrv.time_domain(hrv.guard(beats(s, d))))
query(
    "h4_basic_table",
    f"""WITH {nn_sql()} SELECT subject, sol, count(*) AS n_beats, round(avg(rr), 6) AS mean_rr, round(stddev_pop(rr), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd, round(100 * count(*) FILTER (abs(d) > 50) / (count(*) - 1), 6) AS pnn50, round(60000 / avg(rr), 6) AS mean_hr,
round(60000 / max(rr), 6) AS min_hr, round(60000 / min(rr), 6) AS max_hr, round(max(rr) - min(rr), 6) AS range_nn FROM dd GROUP BY subject, sol HAVING count(*) >= 10""",
)(lambda s, d: hrv.basic_table(beats(s, d)))
POINCARE = """pc AS (SELECT {keys}, coalesce(stddev_pop(d) / sqrt(2), 0) AS sd1, coalesce(stddev_pop(s) / sqrt(2), 0) AS sd2 FROM dd GROUP BY {keys})"""
query("h7_poincare", f"WITH {nn_sql()}, {POINCARE.format(keys=SEG)} SELECT subject, sol, {r6('sd1', 'sd2')}, round(CASE WHEN sd1 > 0 THEN sd2 / sd1 ELSE 0 END, 6) AS sd1_sd2_ratio, round(pi() * sd1 * sd2, 2) AS ellipse_area FROM pc")(
    lambda s, d: rounded(hrv.poincare(beats(s, d))).withColumn("ellipse_area", F.round("ellipse_area", 2))
)
query(
    "h8_poincare_ellipse",
    f"""WITH {nn_sql('subject')}, {POINCARE.format(keys='subject')}, m AS (SELECT subject, avg(rr) AS m FROM nn GROUP BY subject), k AS (SELECT *, unnest(range(100)) AS k FROM pc JOIN m USING (subject)),
a AS (SELECT *, sqrt(5.991::DOUBLE) * sd2 * cos(k * (2 * pi() / 99)) AS u, sqrt(5.991::DOUBLE) * sd1 * sin(k * (2 * pi() / 99)) AS v FROM k) SELECT subject, CAST(k AS INT) AS k, round(m + (u - v) / sqrt(2), 6) AS x, round(m + (u + v) / sqrt(2), 6) AS y FROM a""",
)(lambda s, d: hrv.poincare_ellipse(beats(s, d, SUBJECT), SUBJECT))
query(
    "hrv_core_metrics",
    f"""WITH {nn_sql()}, {TIME.format(keys=SEG)}, {POINCARE.format(keys=SEG)} SELECT subject, sol, n, round(mean_nni, 6) AS mean_nni, round(sdnn, 6) AS sdnn, round(rmssd, 6) AS rmssd, round(pnn50, 6) AS pnn50, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2 FROM tt JOIN pc USING (subject, sol)""",
)(lambda s, d: hrv.core(hrv.guard(beats(s, d))))


def _histogram(bins: int, keys: str) -> str:
    return f"""lim AS (SELECT {keys}, count(*) AS n, min(rr) AS lo, max(rr) AS hi FROM nn GROUP BY {keys}),
hb AS (SELECT {keys}, n, lo, hi, CASE WHEN hi > lo THEN least(CAST(floor((rr - lo) / (hi - lo) * {bins}) AS INT), {bins - 1}) ELSE 0 END AS b FROM nn JOIN lim USING ({keys})),
pk AS (SELECT {keys}, n, lo, hi, max(c) AS peak FROM (SELECT {keys}, n, lo, hi, b, count(*) AS c FROM hb GROUP BY ALL) GROUP BY ALL)"""


query("h12_triangular", f"WITH {nn_sql()}, {_histogram(128, SEG)} SELECT subject, sol, round(CASE WHEN n >= 50 THEN 2 * n / peak ELSE 0 END, 6) AS tinn, round(CASE WHEN n >= 50 THEN n / peak ELSE 0 END, 6) AS triangular_index FROM pk")(lambda s, d: hrv.triangular(beats(s, d)))

SPECTRUM = """tb AS (SELECT {keys}, i, rr, (sum(rr) OVER (PARTITION BY {keys} ORDER BY i)) / 1000 - rr / 2000 AS t, count(*) OVER (PARTITION BY {keys}) AS n, (sum(rr) OVER (PARTITION BY {keys})) / 1000 AS total FROM nn),
tl AS (SELECT *, lead(t) OVER w AS t2, lead(rr) OVER w AS x2 FROM tb WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
gr AS (SELECT {keys}, t, t2, rr, x2, unnest(generate_series(CAST(CASE WHEN i = 1 THEN 0 ELSE ceil(t * 4) END AS BIGINT), CAST(CASE WHEN i = n - 1 THEN ceil(total * 4) - 1 ELSE ceil(t2 * 4) - 1 END AS BIGINT))) AS g FROM tl WHERE t2 IS NOT NULL AND n >= 50),
gx AS (SELECT {keys}, g, rr + (g / 4.0::DOUBLE - t) / (t2 - t) * (x2 - rr) AS x FROM gr),
ft AS (SELECT {keys}, count(*) AS big_n, regr_slope(x, g) AS sl, regr_intercept(x, g) AS ic, CAST(least(floor(count(*) / 4), 256) AS INT) AS m FROM gx GROUP BY {keys}),
fh AS (SELECT *, m - m // 2 AS hop, (big_n - m) // (m - m // 2) + 1 AS windows FROM ft),
wx AS (SELECT {keys}, m, w, g - w * hop AS j, x - sl * g - ic AS x FROM gx JOIN fh USING ({keys}), range(0, windows) AS r(w) WHERE g >= w * hop AND g < w * hop + m),
wy AS (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / m) AS h, (x - avg(x) OVER (PARTITION BY {keys}, w)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / m)) AS y FROM wx),
ff AS (SELECT {keys}, m, w, k, sum(y * cos(2 * pi() * k * j / m)) AS re, sum(y * sin(2 * pi() * k * j / m)) AS im, sum(h * h) AS ww FROM wy, range(0, m // 2 + 1) AS q(k) WHERE k * 4.0::DOUBLE / m < 0.4 GROUP BY ALL),
ps AS (SELECT {keys}, m AS nperseg, k, k * 4.0::DOUBLE / m AS freq, avg(CASE WHEN k = 0 OR k * 2 = m THEN 1 ELSE 2 END * (re * re + im * im) / (4 * ww)) AS power FROM ff GROUP BY ALL),
bd AS (SELECT *, CASE WHEN freq >= 0.0033 AND freq < 0.04 THEN 'vlf' WHEN freq >= 0.04 AND freq < 0.15 THEN 'lf' WHEN freq >= 0.15 AND freq < 0.4 THEN 'hf' END AS band FROM ps),
ba AS (SELECT *, (lead(power) OVER w + power) / 2 * (lead(freq) OVER w - freq) AS area FROM bd WHERE band IS NOT NULL WINDOW w AS (PARTITION BY {keys}, band ORDER BY k)),
bp AS (SELECT {keys}, band, coalesce(sum(area), 0) AS p, arg_max(freq, power) AS top FROM ba GROUP BY {keys}, band),
fb AS (SELECT {keys}, coalesce(max(p) FILTER (band = 'vlf'), 0) AS vlf_power, coalesce(max(p) FILTER (band = 'lf'), 0) AS lf_power, coalesce(max(p) FILTER (band = 'hf'), 0) AS hf_power, coalesce(max(top) FILTER (band = 'vlf' AND p > 0), 0) AS vlf_peak,
 coalesce(max(top) FILTER (band = 'lf' AND p > 0), 0) AS lf_peak, coalesce(max(top) FILTER (band = 'hf' AND p > 0), 0) AS hf_peak FROM bp GROUP BY {keys}),
fa AS (SELECT {keys}, coalesce(vlf_power, 0) AS vlf_power, coalesce(lf_power, 0) AS lf_power, coalesce(hf_power, 0) AS hf_power, coalesce(vlf_peak, 0) AS vlf_peak, coalesce(lf_peak, 0) AS lf_peak, coalesce(hf_peak, 0) AS hf_peak FROM (SELECT DISTINCT {keys} FROM nn) LEFT JOIN fb USING ({keys})),
fd AS (SELECT {keys}, vlf_power, lf_power, hf_power, vlf_power + lf_power + hf_power AS total_power, CASE WHEN lf_power + hf_power > 0 THEN 100 * lf_power / (lf_power + hf_power) ELSE 0 END AS lf_nu, CASE WHEN lf_power + hf_power > 0 THEN 100 * hf_power / (lf_power + hf_power) ELSE 0 END AS hf_nu,
 CASE WHEN hf_power > 0 THEN lf_power / hf_power ELSE 0 END AS lf_hf_ratio, CASE WHEN vlf_power + lf_power + hf_power > 0 THEN 100 * vlf_power / (vlf_power + lf_power + hf_power) ELSE 0 END AS vlf_percent, CASE WHEN vlf_power + lf_power + hf_power > 0 THEN 100 * lf_power / (vlf_power + lf_power + hf_power) ELSE 0 END AS lf_percent,
 CASE WHEN vlf_power + lf_power + hf_power > 0 THEN 100 * hf_power / (vlf_power + lf_power + hf_power) ELSE 0 END AS hf_percent, vlf_peak, lf_peak, hf_peak FROM fa)"""
FREQUENCY_COLUMNS = ("vlf_power", "lf_power", "hf_power", "total_power", "lf_nu", "hf_nu", "lf_hf_ratio", "vlf_percent", "lf_percent", "hf_percent", "vlf_peak", "lf_peak", "hf_peak")


def r4(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


query("h5_frequency_domain", f"WITH {nn_sql()}, {SPECTRUM.format(keys=SEG)} SELECT subject, sol, {r4(*FREQUENCY_COLUMNS)} FROM fd")(lambda s, d: rounded(hrv.frequency_domain(beats(s, d)), 4))
query("h6_psd", f"WITH {nn_sql('subject')}, {SPECTRUM.format(keys='subject')} SELECT subject, CAST(k AS INT) AS k, round(freq, 6) AS freq, round(power, 3) AS power FROM ps")(
    lambda s, d: hrv.psd(beats(s, d, SUBJECT), SUBJECT).select("subject", "k", "freq", F.round("power", 3).alias("power"))
)
DFA = """yy AS (SELECT {keys}, i, sum(rr - mean) OVER (PARTITION BY {keys} ORDER BY i) AS y, n FROM (SELECT *, avg(rr) OVER (PARTITION BY {keys}) AS mean, count(*) OVER (PARTITION BY {keys}) AS n FROM nn) WHERE n >= 100),
pieces AS (SELECT {keys}, y, scale, n // scale AS whole, (i - 1) // scale AS box, (i - 1) % scale AS x FROM yy, range(4, 65) AS r(scale) WHERE scale < n // 4),
bx AS (SELECT {keys}, scale, box, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx FROM pieces WHERE box < whole AND whole >= 4 GROUP BY {keys}, scale, box),
fl AS (SELECT {keys}, scale, log10(avg(sqrt(greatest(yy - xy * xy / xx, 0) / scale))) AS ly FROM bx GROUP BY {keys}, scale),
al AS (SELECT {keys}, CASE WHEN count(*) FILTER (scale <= 16) > 2 THEN regr_slope(ly, log10(scale)) FILTER (scale <= 16) ELSE 0 END AS a1, CASE WHEN count(*) FILTER (scale >= 16) > 2 THEN regr_slope(ly, log10(scale)) FILTER (scale >= 16) ELSE 0 END AS a2 FROM fl GROUP BY {keys}),
df AS (SELECT {keys}, coalesce(a1, 0) AS dfa_alpha1, coalesce(a2, 0) AS dfa_alpha2 FROM (SELECT DISTINCT {keys} FROM nn) LEFT JOIN al USING ({keys}))"""
query("h9_dfa", f"WITH {nn_sql('subject')}, {DFA.format(keys='subject')} SELECT subject, round(dfa_alpha1, 6) AS dfa_alpha1, round(dfa_alpha2, 6) AS dfa_alpha2 FROM df")(lambda s, d: hrv.dfa(beats(s, d, SUBJECT), SUBJECT))
ENTROPY = """tp AS (SELECT {keys}, i, rr AS x0, lead(rr) OVER w AS x1, lead(rr, 2) OVER w AS x2, count(*) OVER (PARTITION BY {keys}) AS n, 0.2::DOUBLE * stddev_pop(rr) OVER (PARTITION BY {keys}) AS tol FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
hc AS (SELECT {akeys}, a.i, any_value(a.n) AS n, any_value(a.x2) AS x2, count(*) AS c, count(*) FILTER (abs(a.x2 - b.x2) <= a.tol) AS c1 FROM tp a JOIN tp b USING ({keys}) WHERE a.n >= {least} AND a.x1 IS NOT NULL AND b.x1 IS NOT NULL AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol GROUP BY {akeys}, a.i),
en AS (SELECT {keys}, avg(ln(c / (n - 1))) - avg(CASE WHEN x2 IS NOT NULL THEN ln(c1 / (n - 2)) END) AS e FROM hc GROUP BY {keys})"""


def entropy_sql(keys: str, src: str = "nn", least: int = 50) -> str:
    return ENTROPY.format(keys=keys, akeys=keys, src=src, least=least)


query("h10_h11_entropy", f"WITH {nn_sql()}, {entropy_sql(SEG)} SELECT subject, sol, round(coalesce(e, 0), 6) AS sample_entropy, round(coalesce(e, 0), 6) AS approximate_entropy FROM (SELECT DISTINCT subject, sol FROM nn) LEFT JOIN en USING (subject, sol)")(
    lambda s, d: hrv.entropy(beats(s, d))
)
PARA = """la AS (SELECT subject, sol, stddev_pop(rr) AS rsa_amplitude FROM (SELECT *, row_number() OVER (PARTITION BY subject, sol ORDER BY i DESC) AS back FROM nn) WHERE back <= 100 GROUP BY subject, sol),
pj AS (SELECT *, (least(1, rmssd / 100) + least(1, pnn50 / 50) + hf_nu / 100 + least(1, sd1 / 50)) / 4 AS parasympathetic_index, hf_peak AS respiratory_frequency, CASE WHEN rmssd > 0 THEN hf_power / rmssd ELSE 0 END AS hf_rmssd_ratio,
 0.4::DOUBLE * hf_nu / 100 + 0.25::DOUBLE * least(1, rmssd / 100) + 0.2::DOUBLE * pnn50 / 100 + 0.15::DOUBLE * least(1, sd1 / 50) AS vagal_tone_index, CASE WHEN n >= 50 AND hf_peak > 0 THEN least(1, CASE WHEN total_power > 0 THEN 10 * hf_power / total_power ELSE 0 END) ELSE 0 END AS respiratory_coherence
 FROM tt JOIN fd USING (subject, sol) JOIN pc USING (subject, sol) JOIN la USING (subject, sol))"""
_ALL = f"WITH {nn_sql()}, {SPECTRUM.format(keys=SEG)}, {TIME.format(keys=SEG)}, {POINCARE.format(keys=SEG)}, {PARA}, {_histogram(50, SEG)}"
query("h13_parasympathetic", f"{_ALL} SELECT subject, sol, {r4('hf_power', 'rmssd', 'pnn50', 'sd1', 'hf_nu', 'parasympathetic_index', 'rsa_amplitude', 'respiratory_frequency', 'hf_rmssd_ratio', 'vagal_tone_index', 'respiratory_coherence')} FROM pj")(
    lambda s, d: rounded(hrv.parasympathetic(beats(s, d)), 4)
)
SYMP = """si AS (SELECT subject, sol, CASE WHEN (hi - lo) * sqrt(lo * hi) > 0 THEN 100 * peak / n / (2 * (hi - lo) * sqrt(lo * hi)) ELSE 0 END AS stress_index FROM pk),
cv AS (SELECT subject, sol, stddev_pop(rr) / avg(rr) AS cv FROM nn GROUP BY subject, sol),
sj AS (SELECT *, (lf_nu / 100 + least(1, lf_hf_ratio / 5) + least(1, stress_index / 100)) / 3 AS sympathetic_index, (hf_nu - lf_nu) / 100 AS autonomic_balance, lf_hf_ratio AS sympathovagal_balance,
 0.5::DOUBLE * lf_nu / 100 + 0.3::DOUBLE * least(1, stress_index / 100) + 0.2::DOUBLE * CASE WHEN mean_hr > 60 THEN least(1, (mean_hr - 60) / 60) ELSE 0 END AS cardiac_sympathetic_index,
 CASE WHEN sdnn > 0 THEN (CASE WHEN lf_power > 0 THEN least(1, log10(lf_power + 1) / 4) ELSE 0 END + least(1, sdnn / 100)) / 2 ELSE 0 END AS sympathetic_modulation, CASE WHEN n >= 50 THEN least(1, cv / 0.1::DOUBLE) ELSE 0 END AS beta_adrenergic_sensitivity
 FROM tt JOIN fd USING (subject, sol) JOIN si USING (subject, sol) JOIN cv USING (subject, sol))"""
query("h17_h18_sympathetic", f"{_ALL}, {SYMP} SELECT subject, sol, {r4('lf_power', 'lf_nu', 'lf_hf_ratio', 'stress_index', 'sympathetic_index', 'autonomic_balance', 'sympathovagal_balance', 'cardiac_sympathetic_index', 'sympathetic_modulation', 'beta_adrenergic_sensitivity')} FROM sj")(
    lambda s, d: rounded(hrv.sympathetic(beats(s, d)), 4)
)
REACT = """rw AS (SELECT {keys}, n, least(30, n // 10) AS size, (i - 1) // least(30, n // 10) AS win, rr FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM nn) WHERE n >= 100),
rs AS (SELECT {keys}, win, stddev_pop(rr) AS sd FROM rw WHERE win * size < n - size GROUP BY ALL),
rx AS (SELECT {keys}, CASE WHEN count(*) > 1 THEN least(1, CASE WHEN avg(sd) > 0 THEN stddev_pop(sd) / avg(sd) ELSE 0 END) ELSE 0 END AS v FROM rs GROUP BY {keys})"""
query("h21_reactivity", f"WITH {nn_sql('subject')}, {REACT.format(keys='subject')} SELECT subject, round(coalesce(v, 0), 6) AS autonomic_reactivity FROM (SELECT DISTINCT subject FROM nn) LEFT JOIN rx USING (subject)")(lambda s, d: hrv.reactivity(beats(s, d, SUBJECT), SUBJECT))
query("h22_baroreflex", f"WITH {nn_sql('subject')}, n2 AS (SELECT subject, d, lead(d) OVER (PARTITION BY subject ORDER BY i) AS d2 FROM dd) SELECT subject, round(CASE WHEN count(*) >= 100 THEN least(20, 20 * abs(coalesce(nullif(corr(-d, d2), 'nan'::DOUBLE), 0))) ELSE 0 END, 6) AS baroreflex_sensitivity FROM n2 GROUP BY subject")(
    lambda s, d: hrv.baroreflex(beats(s, d, SUBJECT), SUBJECT)
)
query(
    "h20_complexity",
    f"""WITH {nn_sql('subject')}, cg AS (SELECT subject, scale, (i - 1) // scale + 1 AS i, avg(rr) AS rr FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM nn), (VALUES (1), (2), (4), (8)) AS v(scale) WHERE n >= 100 AND ((i - 1) // scale + 1) * scale <= n GROUP BY ALL),
{entropy_sql('subject, scale', 'cg', 51)} SELECT subject, round(coalesce(avg(e), 0), 6) AS ans_complexity FROM (SELECT DISTINCT subject FROM nn) LEFT JOIN en USING (subject) GROUP BY subject""",
)(lambda s, d: hrv.complexity(beats(s, d, SUBJECT), SUBJECT))
COUPLING = f"""WITH {nn_sql('subject')},
wn AS (SELECT subject, i, rr, n, size, size // 2 AS hop, CAST(ceil((n - size) / (size // 2)) AS BIGINT) AS windows FROM (SELECT *, least(60, n // 4) AS size FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM nn) WHERE n >= 100)),
w2 AS (SELECT subject, win, i - win * hop AS i, rr FROM (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((i - size) / hop) AS BIGINT)), least(windows - 1, (i - 1) // hop))) AS win FROM wn)),
{SPECTRUM.format(keys='subject, win').replace('FROM nn', 'FROM w2')},
wr AS (SELECT subject, win, coalesce(sqrt(avg(d * d)), 0) AS rmssd FROM (SELECT *, rr - lag(rr) OVER (PARTITION BY subject, win ORDER BY i) AS d FROM w2) GROUP BY subject, win),
cr AS (SELECT subject, CASE WHEN count(*) > 3 THEN coalesce(nullif(corr(hf_power, rmssd), 'nan'::DOUBLE), 0) ELSE 0 END AS r FROM fd JOIN wr USING (subject, win) GROUP BY subject)"""
query("h14_rsa_coupling", COUPLING + " SELECT subject, round(coalesce(r, 0), 6) AS rsa_coupling_index FROM (SELECT DISTINCT subject FROM nn) LEFT JOIN cr USING (subject)")(lambda s, d: hrv.rsa_coupling(beats(s, d, SUBJECT), SUBJECT))
ANS = f"""{_ALL}, {SYMP}, {REACT.format(keys=SEG)},
cg AS (SELECT subject, sol, scale, (i - 1) // scale + 1 AS i, avg(rr) AS rr FROM (SELECT *, count(*) OVER (PARTITION BY subject, sol) AS n FROM nn), (VALUES (1), (2), (4), (8)) AS v(scale) WHERE n >= 100 AND ((i - 1) // scale + 1) * scale <= n GROUP BY ALL),
{entropy_sql('subject, sol, scale', 'cg', 51)},
cx AS (SELECT subject, sol, avg(e) AS c FROM en GROUP BY subject, sol),
bf AS (SELECT subject, sol, CASE WHEN count(*) >= 100 THEN least(20, 20 * abs(coalesce(nullif(corr(-d, d2), 'nan'::DOUBLE), 0))) ELSE 0 END AS b FROM (SELECT *, lead(d) OVER (PARTITION BY subject, sol ORDER BY i) AS d2 FROM dd) GROUP BY subject, sol),
aj AS (SELECT subject, sol, sj.lf_hf_ratio, autonomic_balance, parasympathetic_index AS pa, sympathetic_index AS sy, stress_index AS st, coalesce(c, 0) AS ans_complexity, coalesce(v, 0) AS autonomic_reactivity, b AS baroreflex_sensitivity,
 least(1, CASE WHEN sj.hf_nu > 0 THEN sj.lf_nu / sj.hf_nu ELSE 10 END / 10) AS traditional FROM sj JOIN pj USING (subject, sol) LEFT JOIN cx USING (subject, sol) LEFT JOIN rx USING (subject, sol) JOIN bf USING (subject, sol)),
ab AS (SELECT *, (traditional + CASE WHEN st + pa * 100 > 0 THEN st / (st + pa * 100) ELSE 0.5 END) / 2 AS sympathovagal_index, CASE WHEN pa + sy > 0 THEN pa / (pa + sy) ELSE 0.5 END AS cardiac_autonomic_balance FROM aj)"""
ANS_COLUMNS = ("lf_hf_ratio", "autonomic_balance", "sympathovagal_index", "ans_complexity", "cardiac_autonomic_balance", "autonomic_reactivity", "baroreflex_sensitivity")
query("h19_ans_balance", f"{ANS} SELECT subject, sol, {r4(*ANS_COLUMNS)} FROM ab")(lambda s, d: rounded(hrv.ans_balance(beats(s, d)), 4))
query(
    "h32_extended",
    f"""WITH {nn_sql()}, {POINCARE.format(keys=SEG)}, mr AS (SELECT subject, sol, quantile_cont(rr, 0.5) AS median_nn, max(rr) - min(rr) AS range_nn FROM nn GROUP BY subject, sol)
SELECT subject, sol, {r6('median_nn', 'range_nn')}, round(CASE WHEN sd1 > 0 THEN sd2 / sd1 ELSE 0 END, 6) AS csi, round(CASE WHEN sd1 > 0 AND sd2 > 0 THEN log10(16 * sd1 * sd2) ELSE 0 END, 6) AS cvi, round(CASE WHEN sd1 > 0 THEN 4 * sd2 * sd2 / sd1 ELSE 0 END, 4) AS modified_csi FROM pc JOIN mr USING (subject, sol)""",
)(lambda s, d: rounded(hrv.extended(beats(s, d))).withColumn("modified_csi", F.round("modified_csi", 4)))
query(
    "h25_analysis_quality",
    f"""{_ALL}, qq AS (SELECT subject, sol, n, rmssd, total_power, (SELECT sum(rr) / 60000 FROM nn WHERE nn.subject = tt.subject AND nn.sol = tt.sol) AS minutes FROM tt JOIN fd USING (subject, sol)),
qa AS (SELECT *, list_filter([CASE WHEN n < 50 THEN 'insufficient data' WHEN n < 200 THEN 'short recording' END, CASE WHEN rmssd <= 10 THEN 'low rmssd' END, CASE WHEN total_power <= 100 THEN 'low power' END, CASE WHEN rmssd <= 10 OR total_power <= 100 THEN 'consider preprocessing' END], lambda x: x IS NOT NULL) AS a FROM qq)
SELECT subject, sol, n AS n_intervals, CASE WHEN n < 50 THEN 'poor' WHEN n < 200 THEN 'fair' WHEN n < 500 THEN 'good' ELSE 'excellent' END AS data_quality, CASE WHEN rmssd > 10 AND total_power > 100 THEN 'high' ELSE 'low' END AS reliability, round(minutes, 6) AS minutes,
CASE WHEN len(a) > 0 THEN array_to_string(a, ';') ELSE 'acceptable' END AS recommendations FROM qa""",
)(lambda s, d: hrv.analysis_quality(beats(s, d)))
_TEMPLATES = entropy_sql(SEG).replace("tp ", "tn ").replace("hc ", "hn ").replace("en AS", "es AS")
_PEAK128 = _histogram(128, SEG).replace("lim ", "lim2 ").replace("JOIN lim", "JOIN lim2").replace("hb ", "hb2 ").replace("FROM hb", "FROM hb2").replace("pk AS", "pk2 AS").replace("hb22", "hb2").replace("lim22", "lim2")
ALL_DOMAINS = f"""{ANS}, {DFA.format(keys=SEG)}, {_TEMPLATES}, {_PEAK128},
nl AS (SELECT subject, sol, sd1, sd2, CASE WHEN sd1 > 0 THEN sd2 / sd1 ELSE 0 END AS sd1_sd2_ratio, pi() * sd1 * sd2 AS ellipse_area, dfa_alpha1, dfa_alpha2, coalesce(e, 0) AS sample_entropy, coalesce(e, 0) AS approximate_entropy, CASE WHEN n >= 50 THEN 2 * n / peak ELSE 0 END AS tinn, CASE WHEN n >= 50 THEN n / peak ELSE 0 END AS triangular_index
 FROM pc JOIN df USING (subject, sol) LEFT JOIN es USING (subject, sol) JOIN pk2 USING (subject, sol))"""
DOMAIN_SQL = {
    "time": ("tt", ("n", "mean_nni", "sdnn", "rmssd", "nn50", "pnn50", "nn20", "pnn20", "sdsd", "cvsd", "cvnn", "mcv_nni", "median_nni", "mad_nni", "mean_hr", "std_hr", "min_hr", "max_hr")),
    "frequency": ("fd", FREQUENCY_COLUMNS),
    "nonlinear": ("nl", ("sd1", "sd2", "sd1_sd2_ratio", "ellipse_area", "dfa_alpha1", "dfa_alpha2", "sample_entropy", "approximate_entropy", "tinn", "triangular_index")),
    "parasympathetic": ("pj", ("hf_power", "rmssd", "pnn50", "sd1", "hf_nu", "parasympathetic_index", "rsa_amplitude", "respiratory_frequency", "hf_rmssd_ratio", "vagal_tone_index", "respiratory_coherence")),
    "sympathetic": ("sj", ("lf_power", "lf_nu", "lf_hf_ratio", "stress_index", "sympathetic_index", "autonomic_balance", "sympathovagal_balance", "cardiac_sympathetic_index", "sympathetic_modulation", "beta_adrenergic_sensitivity")),
    "ans": ("ab", ANS_COLUMNS),
}
_WHOLE = {"n", "nn50", "nn20"}


def _domains(columns: dict[str, str], digits: int) -> str:
    """The given analysis columns, renamed."""
    named = {f"{d}_{c}": (f"{t}.{c}", c) for d, (t, cs) in DOMAIN_SQL.items() for c in cs}
    shown = ", ".join(f"{named[c][0]} AS {name}" if named[c][1] in _WHOLE else f"round({named[c][0]}, {digits}) AS {name}" for name, c in columns.items())
    joins = " ".join(f"JOIN {t} USING (subject, sol)" for t, _ in list(DOMAIN_SQL.values())[1:])
    return f"{ALL_DOMAINS} SELECT subject, sol, {shown} FROM tt {joins}"


query("h26_all_domains", _domains({f"{d}_{c}": f"{d}_{c}" for d, (_, cs) in DOMAIN_SQL.items() for c in cs}, 3))(lambda s, d: rounded(hrv.analyse(beats(s, d)), 3))
query("h31_phase_rows", _domains(hrv.PHASE_ROW, 3))(lambda s, d: rounded(hrv.phase_rows(hrv.analyse(beats(s, d))), 3))
