"""Clustering, forecasting and source plans, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.functions.columns import rounded
from pulseloom.operators import arima, cluster, forecast, hrv, mixed, neighbours, splines
from pulseloom.operators import models as linear
from pulseloom.operators.density import density
from pulseloom.plans.base import SUBJECT, beats, nn_sql
from pulseloom.plans.groups import SERIES, _long, series
from pulseloom.plans.hrv import TIME
from pulseloom.sources.files import header_report, sample_rows
from pulseloom.sources.samples import event_samples, table
from pulseloom.streaming.live import windowed_heart_rate

QUERIES, ORACLES = {}, {}
FEATURES = ("mean_nni", "sdnn", "rmssd", "pnn50", "mean_hr")


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _metrics(s, d):
    return hrv.time_domain(beats(s, d)).select("subject", "sol", *FEATURES)


_T = f"WITH {nn_sql()}, {TIME.format(keys='subject, sol')}, f AS (SELECT subject, sol, mean_nni, sdnn, rmssd, CAST(pnn50 AS DOUBLE) AS pnn50, mean_hr FROM tt)"
query("m1_prepare", _T + " SELECT subject, sol, " + ", ".join(f"round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 6) AS z_{f}" for f in FEATURES) + " FROM f")(lambda s, d: (lambda p: p[0].select("subject", "sol", *[f"z_{f}" for f in p[1]]))(cluster.prepare(_metrics(s, d), FEATURES)))
query("m2_kmeans")(lambda s, d: (lambda p: cluster.profiles(cluster.kmeans(p[0], p[1], 3), FEATURES))(cluster.prepare(_metrics(s, d), FEATURES)))
query("m3_bisecting")(lambda s, d: (lambda p: cluster.profiles(cluster.bisecting(p[0], p[1], 3), FEATURES))(cluster.prepare(_metrics(s, d), FEATURES)))
_KEYED = lambda s, d: (lambda p: p[0].withColumn("id0", F.concat_ws(":", "subject", F.col("sol").cast("string"))))(cluster.prepare(_metrics(s, d), FEATURES))
_DENSE = _T + f""", x AS (SELECT subject || ':' || sol AS id, {', '.join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in FEATURES)} FROM f), nb AS (SELECT a.id AS p, b.id AS q FROM x a JOIN x b ON {{near}} <= {{eps}} * {{eps}}),
co AS (SELECT p FROM nb GROUP BY p HAVING count(*) >= 4), ln AS (SELECT p, q FROM nb WHERE p IN (SELECT p FROM co) AND q IN (SELECT p FROM co)), rc AS (SELECT p AS root, p AS node FROM co UNION SELECT root, q FROM rc JOIN ln ON ln.p = rc.node),
lb AS (SELECT node, min(root) AS label FROM rc GROUP BY node), bd AS (SELECT nb.p AS id, min(label) AS label FROM nb JOIN lb ON lb.node = nb.q GROUP BY nb.p)"""
_DENSE = _DENSE.replace("WITH ", "WITH RECURSIVE ", 1)


def _near(*features: str) -> str:
    return " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in features)


query("m4_density", _DENSE.format(near=_near("mean_nni", "rmssd"), eps="0.5::DOUBLE") + " SELECT coalesce(label, '-1') AS cluster, count(*) AS n FROM x LEFT JOIN bd USING (id) GROUP BY ALL")(
    lambda s, d: density(_KEYED(s, d), ["z_mean_nni", "z_rmssd"], 0.5, 4, "id0").groupBy("cluster").agg(F.count("*").alias("n"))
)
query("m4_density_four", _DENSE.format(near=_near("mean_nni", "sdnn", "rmssd", "pnn50"), eps="0.9::DOUBLE") + " SELECT id AS id0, coalesce(label, '-1') AS cluster FROM x LEFT JOIN bd USING (id)")(
    lambda s, d: density(_KEYED(s, d), ["z_mean_nni", "z_sdnn", "z_rmssd", "z_pnn50"], 0.9, 4, "id0").select("id0", "cluster")
)
query("m5_choose_k")(lambda s, d: (lambda p: cluster.choose_k(p[0], p[1]))(cluster.prepare(_metrics(s, d), FEATURES)))


def _labelled(s, d):
    """Embeddings' first two dimensions with their given label as cluster."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("cluster"))
    return e.withColumns({"z_x": F.col("x"), "z_y": F.col("y")})


EMB = "e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS cluster FROM embeddings), c AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM e GROUP BY cluster)"
query(
    "m6_validate",
    f"""WITH {EMB}, g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS total FROM e), i AS (SELECT cluster, sum(pow(x - cx, 2) + pow(y - cy, 2)) AS w, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS s FROM e JOIN c USING (cluster) GROUP BY cluster),
t AS (SELECT * FROM c JOIN i USING (cluster), g), h AS (SELECT count(*) AS k, (sum(n * (pow(cx - gx, 2) + pow(cy - gy, 2))) / (count(*) - 1)) / (sum(w) / (any_value(total) - count(*))) AS ch, sum(w) AS w FROM t),
r AS (SELECT a.cluster, max((a.s + b.s) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS r FROM t a JOIN t b ON a.cluster <> b.cluster GROUP BY a.cluster)
SELECT k, round(ch, 5) AS calinski_harabasz, round(w, 5) AS inertia, round((SELECT avg(r) FROM r), 5) AS davies_bouldin FROM h""",
    5,
)(lambda s, d: cluster.validate(_labelled(s, d), ("x", "y")))
query("m7_assign", f"WITH {EMB}, a AS (SELECT vec_id, c.cluster AS nearest, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS distance FROM e, c) SELECT vec_id, nearest, round(distance, 6) AS distance FROM a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) = 1")(
    lambda s, d: (lambda e: cluster.assign(e, e.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), ("x", "y")).select("vec_id", "nearest", "distance"))(_labelled(s, d))
)
query("m8_importance", f"WITH {EMB} SELECT 'x' AS feature, round(var_pop(cx), 8) AS importance FROM c UNION ALL SELECT 'y', round(var_pop(cy), 8) FROM c", 8)(lambda s, d: cluster.importance(_labelled(s, d), ("x", "y")))
query("m9_phenotypes", _T + """, p AS (SELECT subject AS cluster, avg(rmssd) AS rmssd, avg(pnn50) AS pnn50, avg(mean_hr) AS mean_hr, avg(sdnn) AS sdnn FROM f GROUP BY subject), s AS (SELECT cluster, (rmssd + pnn50) / 2 AS a, mean_hr AS b, sdnn AS c, -(sdnn + rmssd) / 2 AS e FROM p)
SELECT cluster, CASE greatest(a, b, c, e) WHEN a THEN 'parasympathetic' WHEN b THEN 'sympathetic' WHEN c THEN 'balanced' ELSE 'low_variability' END AS phenotype FROM s""")(
    lambda s, d: cluster.phenotypes(_metrics(s, d).groupBy(F.col("subject").alias("cluster")).agg(*[F.avg(f).alias(f) for f in ("rmssd", "pnn50", "mean_hr", "sdnn")])).select("cluster", "phenotype")
)
query("m10_series", "WITH b AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day, quantile_cont(o_totalprice, 0.5) AS y FROM orders GROUP BY ALL) SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i, round(y, 4) AS y FROM b QUALIFY count(*) OVER (PARTITION BY series_id) >= 3", 4)(
    lambda s, d: forecast.build_series(table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), "o_orderpriority", "day", "o_totalprice", "median")
)
query("m11_kpss", f"WITH {SERIES}, e AS (SELECT series_id, i, y - avg(y) OVER (PARTITION BY series_id) AS e FROM si), c AS (SELECT series_id, e, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS s FROM e), k AS (SELECT series_id, sum(s * s) / (count(*) * sum(e * e)) AS kpss FROM c GROUP BY series_id) SELECT series_id, round(kpss, 6) AS kpss, kpss < 0.463 AS kpss_stationary FROM k")(lambda s, d: forecast.kpss(series(s, d)))
query(
    "m11_adf",
    f"""WITH {SERIES}, d1 AS (SELECT *, y - lag(y) OVER w AS dy, lag(y) OVER w AS x FROM si WINDOW w AS (PARTITION BY series_id ORDER BY i)), d2 AS (SELECT *, lag(dy) OVER (PARTITION BY series_id ORDER BY i) AS z FROM d1),
c AS (SELECT series_id, count(*) AS n, covar_samp(x, x) AS xx, covar_samp(z, z) AS zz, covar_samp(x, z) AS xz, covar_samp(x, dy) AS xd, covar_samp(z, dy) AS zd, covar_samp(dy, dy) AS dd FROM d2 WHERE z IS NOT NULL GROUP BY series_id),
b AS (SELECT *, (xd * zz - zd * xz) / (xx * zz - xz * xz) AS b, (zd * xx - xd * xz) / (xx * zz - xz * xz) AS g FROM c), t AS (SELECT series_id, b / sqrt((dd - b * xd - g * zd) * (n - 1) / (n - 3) * zz / (xx * zz - xz * xz) / (n - 1)) AS adf FROM b) SELECT series_id, round(adf, 6) AS adf, adf < -2.86 AS adf_stationary FROM t""",
)(lambda s, d: forecast.adf(series(s, d)))
query("m12_autoregression", digits=3)(lambda s, d: forecast.autoregression(series(s, d)))
ARMA = f"""WITH RECURSIVE {SERIES}, l1 AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY i) AS y1 FROM si), b1 AS (SELECT series_id, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS a FROM l1 WHERE y1 IS NOT NULL GROUP BY series_id),
e1 AS (SELECT series_id, i, y, y1, y - a - b * y1 AS e FROM l1 JOIN b1 USING (series_id) WHERE y1 IS NOT NULL), g AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY i) AS e1 FROM e1),
s AS (SELECT series_id, count(*) AS n, covar_pop(y, y) AS yy, covar_pop(y1, y1) AS xx, covar_pop(e1, e1) AS zz, covar_pop(y1, e1) AS xz, covar_pop(y1, y) AS xy, covar_pop(e1, y) AS zy, avg(y) AS my, avg(y1) AS m1, avg(e1) AS me FROM g WHERE i >= 2 GROUP BY series_id),
c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS phi, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS t FROM s), f AS (SELECT *, CASE WHEN abs(t) > 1 THEN 1 / t ELSE t END AS theta, my - phi * m1 - t * me AS k, n * ln(yy - phi * xy - t * zy) + 8 AS aic, n * ln(yy - phi * xy - t * zy) + 4 * ln(n) AS bic FROM c WHERE abs(phi) < 1),
r AS (SELECT l1.series_id, i, y, y - k - phi * y1 AS e FROM l1 JOIN f USING (series_id) WHERE i = 1 UNION ALL SELECT l1.series_id, l1.i, l1.y, l1.y - k - phi * y1 - theta * r.e FROM r JOIN l1 ON l1.series_id = r.series_id AND l1.i = r.i + 1 JOIN f ON f.series_id = r.series_id),
m AS (SELECT series_id, max(i) AS last FROM r GROUP BY series_id), v AS (SELECT r.series_id, any_value(last) AS last, arg_max(y, i) AS y, arg_max(e, i) AS e, avg(e * e) FILTER (i > last - n) AS v, avg(abs(e)) FILTER (i > last - n) AS mae FROM r JOIN m USING (series_id) JOIN f USING (series_id) GROUP BY r.series_id),
h AS (SELECT *, k + phi * y + theta * e AS f1 FROM v JOIN f USING (series_id)), o AS (SELECT series_id, last + 1 AS i, f1 AS forecast, 1 AS w, aic, bic, v, mae FROM h UNION ALL SELECT series_id, last + 2, k + phi * f1, 1 + pow(phi + theta, 2), aic, bic, v, mae FROM h
UNION ALL SELECT series_id, last + 3, k + phi * (k + phi * f1), 1 + pow(phi + theta, 2) + pow(phi * (phi + theta), 2), aic, bic, v, mae FROM h)
SELECT series_id, i, round(forecast, 2) AS forecast, round(forecast - 1.959964 * sqrt(v * w), 2) AS low, round(forecast + 1.959964 * sqrt(v * w), 2) AS high, round(aic, 2) AS aic, round(bic, 2) AS bic, round(sqrt(v), 2) AS rmse, round(mae, 2) AS mae FROM o"""
query("m12_arma", ARMA, 2)(lambda s, d: arima.arima(series(s, d), [(1, 0, 1, 0, 0, 0)], steps=3, long=1).drop("p", "d", "q", "sp", "sd", "sq"))
query("m12_arima", digits=2)(lambda s, d: arima.arima(series(s, d)))
query("m12_seasonal_arima", digits=2)(lambda s, d: arima.arima(series(s, d), arima.SEASONAL, 12))
query("m13_seasonal", digits=3)(lambda s, d: forecast.seasonal_regression(series(s, d)))
SES = f"""WITH RECURSIVE {SERIES}, z AS (SELECT series_id, i, y, y AS smooth FROM si WHERE i = 0 UNION ALL SELECT si.series_id, si.i, si.y, 0.3::DOUBLE * si.y + 0.7::DOUBLE * z.smooth FROM z JOIN si ON si.series_id = z.series_id AND si.i = z.i + 1)"""
query("m14_smoothing", SES + " SELECT series_id, i, round(y, 3) AS y, round(smooth, 3) AS smooth FROM z", 3)(lambda s, d: forecast.exponential_smoothing(series(s, d)))
query("m14_forecast", SES + """, q AS (SELECT series_id, count(*) AS n, arg_max(smooth, i) AS f, sqrt(avg(pow(y - smooth, 2))) AS rmse, avg(abs(y - smooth)) AS mae FROM z GROUP BY series_id)
SELECT series_id, n - 1 + h AS i, round(f, 3) AS forecast, round(f - 0.1::DOUBLE * abs(f), 3) AS low, round(f + 0.1::DOUBLE * abs(f), 3) AS high, round(rmse, 3) AS rmse, round(mae, 3) AS mae FROM q, range(1, 6) AS r(h) WHERE h <= least(n // 2, 5)""", 3)(lambda s, d: forecast.smoothing_forecast(series(s, d)))
query("m15_compare", digits=3)(lambda s, d: (lambda x: forecast.compare({"smoothing": forecast.smoothing_forecast(x), "autoregression": forecast.autoregression(x), "seasonal": forecast.seasonal_regression(x)}))(series(s, d)))
query("m15_ensemble", digits=3)(lambda s, d: (lambda x: forecast.ensemble([forecast.smoothing_forecast(x), forecast.seasonal_regression(x)]))(series(s, d)))
ADAPT = f"""WITH {SERIES}, h AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM si), a AS (SELECT series_id, any_value(n) AS n, regr_slope(y, i) AS slope, stddev_pop(y) AS sd, regr_r2(y, i) AS r2, avg(y) FILTER (i < n // 2) AS f, avg(y) FILTER (i >= n // 2) AS g FROM h GROUP BY series_id),
b AS (SELECT *, CASE WHEN abs(slope) < 0.01 * sd THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM a), ad AS (SELECT *, CASE WHEN n < 4 THEN 'insufficient_data' WHEN abs(g - f) / f < 0.1 THEN 'adapted' WHEN trend = 'stable' THEN 'stabilizing' ELSE 'adapting' END AS phase FROM b)"""
query("m16_adaptation", ADAPT + " SELECT series_id, trend, round(slope, 4) AS slope, round(abs(slope), 4) AS rate, phase, round(r2, 4) AS r2 FROM ad", 4)(lambda s, d: forecast.adaptation(series(s, d)))
query("m16_summary", ADAPT + " SELECT trend, phase, count(*) AS n, round(avg(abs(slope)), 4) AS mean_rate FROM ad GROUP BY trend, phase", 4)(lambda s, d: forecast.adaptation_summary(forecast.adaptation(series(s, d))))
query(
    "m16_outlook",
    SES + """, l AS (SELECT series_id, arg_max(smooth, i) AS f FROM z GROUP BY series_id), r AS (SELECT series_id, avg(y) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i DESC) AS back FROM si) WHERE back <= 3 GROUP BY series_id), c AS (SELECT series_id, (f - recent) / recent AS c FROM l JOIN r USING (series_id))
SELECT series_id, round(c, 6) AS relative_change, CASE WHEN abs(c) < 0.05 THEN 'stable_adaptation' WHEN c > 0.1 THEN 'positive_adaptation' WHEN c < -0.1 THEN 'negative_adaptation' ELSE 'mild_change' END AS outlook FROM c""",
)(lambda s, d: (lambda x: forecast.future_class(x, forecast.smoothing_forecast(x)))(series(s, d)))
query(
    "m17_residuals",
    SES + """, e AS (SELECT series_id, i, y - smooth AS e, (y - smooth) - avg(y - smooth) OVER (PARTITION BY series_id) AS c, count(*) OVER (PARTITION BY series_id) AS n FROM z), v AS (SELECT series_id, sum(c * c) AS v FROM e GROUP BY series_id),
a AS (SELECT a.series_id, lag, any_value(a.n) AS n, sum(a.c * b.c) / any_value(v) AS r FROM range(1, 11) AS q(lag), e a JOIN e b ON a.series_id = b.series_id AND b.i = a.i + lag JOIN v ON v.series_id = a.series_id GROUP BY a.series_id, lag), l AS (SELECT series_id, sum(r * r / (n - lag) * n * (n + 2)) AS lb FROM a GROUP BY series_id),
m AS (SELECT series_id, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS sd, avg(pow(c, 3)) / pow(avg(c * c), 1.5) AS skew, avg(pow(c, 4)) / pow(avg(c * c), 2) - 3 AS kurtosis FROM e GROUP BY series_id)
SELECT series_id, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(n / 6 * (skew * skew + kurtosis * kurtosis / 4), 4) AS jarque_bera, round(lb, 4) AS ljung_box FROM m JOIN l USING (series_id)""",
    4,
)(lambda s, d: forecast.residual_diagnostics(forecast.exponential_smoothing(series(s, d)).select("series_id", "i", (F.col("y") - F.col("smooth")).alias("y"))))
query("m18_trend_strength", f"WITH {SERIES}, n AS (SELECT *, greatest(3, count(*) OVER (PARTITION BY series_id) // 10) AS w, count(*) OVER (PARTITION BY series_id) AS n FROM si), m AS (SELECT a.series_id, a.i, any_value(a.y) AS y, avg(b.y) AS m FROM n a JOIN n b ON a.series_id = b.series_id AND b.i BETWEEN a.i - a.w // 2 AND a.i + a.w - 1 - a.w // 2 WHERE a.n >= 8 GROUP BY a.series_id, a.i) SELECT series_id, round(var_pop(m) / (var_pop(y) + 1e-12), 6) AS strength, CASE WHEN regr_slope(y, i) > 0 THEN 'increasing' WHEN regr_slope(y, i) < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM m GROUP BY series_id")(
    lambda s, d: forecast.trend_strength(series(s, d))
)
query("m19_holdout", SES.replace("si AS (SELECT series_id,", "s0 AS (SELECT series_id,").replace("FROM sr), z AS", "FROM sr), sn AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s0), si AS (SELECT series_id, i, y FROM sn WHERE i < n - 5), z AS") + ", l AS (SELECT series_id, arg_max(smooth, i) AS f FROM z GROUP BY series_id) SELECT series_id, round(avg(abs(y - f)), 3) AS mae, round(sqrt(avg(pow(y - f, 2))), 3) AS rmse, round(100 * avg(abs((y - f) / y)), 3) AS mape FROM sn JOIN l USING (series_id) WHERE i >= n - 5 GROUP BY series_id", 3)(
    lambda s, d: forecast.holdout(series(s, d))
)
query(
    "m20_pooled",
    f"""WITH RECURSIVE {SERIES}, p AS (SELECT i, avg(y) AS y FROM si GROUP BY i), z AS (SELECT i, y AS smooth FROM p WHERE i = 0 UNION ALL SELECT p.i, 0.3::DOUBLE * p.y + 0.7::DOUBLE * z.smooth FROM z JOIN p ON p.i = z.i + 1), o AS (SELECT series_id, avg(si.y - p.y) AS o FROM si JOIN p USING (i) GROUP BY series_id)
SELECT series_id, round(o, 3) AS "offset", round((SELECT arg_max(smooth, i) FROM z) + o, 3) AS forecast FROM o""",
    3,
)(lambda s, d: forecast.pooled(series(s, d)))

# S: sources

query("s6_sample_rows", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")(lambda s, d: sample_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey"))
query("s9_header_report", "SELECT x AS header, CAST(count(DISTINCT source) AS BIGINT) AS n_files, count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents) AS common FROM (SELECT DISTINCT source, lang AS x FROM documents WHERE lang IS NOT NULL) GROUP BY x")(
    lambda s, d: header_report(table(s, d, "documents").where("lang is not null").select(F.col("source").alias("file"), F.col("lang").alias("header")))
)
query("u7_windowed_heart_rate", "SELECT event_type AS subject, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, round(avg(value + 40), 6) AS mean_hr, round(min(value + 40), 6) AS min_hr, round(max(value + 40), 6) AS max_hr FROM events WHERE value + 40 BETWEEN 30 AND 220 GROUP BY ALL")(
    lambda s, d: windowed_heart_rate(event_samples(s, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))
)

# T: models

COLS = ["l_quantity", "l_discount", "l_tax"]
_li = lambda s, d: table(s, d, "lineitem")
query("t21_ols_one_predictor", "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, count(*) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")(
    lambda s, d: linear.ols(_li(s, d), "l_extendedprice", ["l_quantity"]).where("term = 'l_quantity'").select("term", F.round("coef", 4).alias("coef"), "n", "r2")
)
query("t21_ols", digits=4)(lambda s, d: linear.ols(_li(s, d), "l_extendedprice", COLS))
query("t21_confounding", digits=4)(lambda s, d: linear.confounding(_li(s, d), "l_extendedprice", "l_quantity", ["l_discount", "l_tax"]))
query("t22_diagnostics", digits=3)(lambda s, d: linear.diagnostics(_li(s, d), "l_extendedprice", COLS))
_trended = lambda s, d: series(s, d).withColumn("x", F.col("i").cast("double"))
query("t25_spline_trend", digits=3)(lambda s, d: splines.trend(_trended(s, d), "x", "y"))
_MONOMIALS = "SELECT i / 1.0::DOUBLE AS u, i * i / 1.0::DOUBLE AS v, y FROM si"
query(
    "t25_quadratic_trend",
    f"""WITH {SERIES}, q AS ({_MONOMIALS}), c AS (SELECT count(*) AS n, regr_sxx(u, u) AS uu, regr_sxx(v, v) AS vv, regr_sxy(u, v) AS uv, regr_sxy(u, y) AS uy, regr_sxy(v, y) AS vy, regr_sxx(y, y) AS yy FROM q),
b AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b2 FROM c), e AS (SELECT *, yy - b1 * uy - b2 * vy AS sse FROM b)
SELECT 2 AS df, n, round(1 - sse / yy, 6) AS r2, round(8 + n * (ln(2 * pi()) + ln(sse / n) + 1), 3) AS aic, round(4 * ln(n) + n * (ln(2 * pi()) + ln(sse / n) + 1), 3) AS bic FROM e""",
)(lambda s, d: splines.choices(_trended(s, d), "x", "y", (2,)).drop("chosen").withColumns({"aic": F.round("aic", 3), "bic": F.round("bic", 3)}))
query("t25_spline_choices", digits=4)(lambda s, d: splines.choices(_trended(s, d), "x", "y"))
query("t28_outliers")(lambda s, d: linear.mahalanobis_outliers(_metrics(s, d), ["mean_nni", "sdnn", "rmssd"]).groupBy("outlier").agg(F.count("*").alias("n"), F.avg("rmssd").alias("rmssd")))
query("t28_isolation_forest")(lambda s, d: linear.isolation_outliers(_metrics(s, d), ["mean_nni", "sdnn", "rmssd"], ["subject", "sol"]).groupBy("outlier").agg(F.count("*").alias("n"), F.avg("mean_nni").alias("mean_nni"), F.avg("sdnn").alias("sdnn"), F.avg("rmssd").alias("rmssd")))

_OUT, _CTX = ("rmssd", "sdnn"), ("mean_nni", "sol")
query(
    "t29_subgroups",
    _T + " " + " UNION ALL ".join(
        f"SELECT 'subject' AS grouping, subject AS level, '{o}' AS outcome, '{c}' AS factor, round(regr_slope({o}, {c}), 5) AS slope, round(regr_intercept({o}, {c}), 4) AS intercept, round(regr_r2({o}, {c}), 6) AS r2, count(*) AS n, round(corr({o}, {c}), 6) AS r FROM f GROUP BY subject HAVING count(*) >= 20"
        for o in _OUT for c in _CTX
    ),
)(lambda s, d: linear.subgroup_lines(_metrics(s, d), _OUT, _CTX, ["subject"]).drop("se", "p_value").withColumns({"slope": F.round("slope", 5), "intercept": F.round("intercept", 4)}))
query("t29_factor_model", digits=4)(lambda s, d: linear.factor_model(_metrics(s, d), _OUT, _CTX, ["subject"]))
_R2 = "(corr({o}, mean_nni) ** 2 + corr({o}, sol) ** 2 - 2 * corr({o}, mean_nni) * corr({o}, sol) * corr(mean_nni, sol)) / (1 - corr(mean_nni, sol) ** 2)"
query(
    "t29_insights",
    _T + f""", ra AS ({' UNION ALL '.join(f"SELECT '{o}' AS a, '{c}' AS b, corr({o}, {c}) AS r FROM f" for o in _OUT for c in _CTX)}), rb AS (SELECT * FROM ra WHERE abs(r) > 0.1 ORDER BY abs(r) DESC, a, b LIMIT 3), rm AS ({' UNION ALL '.join(f"SELECT '{o}' AS outcome, {_R2.format(o=o)} AS r2 FROM f" for o in _OUT)})
SELECT 'association' AS kind, a AS outcome, b AS factor, round(r, 6) AS measure, printf('strong %s association of %s and %s (r = %.3f)', CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, a, b, r) AS finding FROM rb
UNION ALL SELECT 'model', outcome, NULL, round(r2, 6), printf('the factors explain %.1f %% of the variance of %s', 100 * r2, outcome) FROM rm WHERE r2 > 0.01""",
)(lambda s, d: linear.insights(_metrics(s, d), _OUT, _CTX, least_r=0.1, least_r2=0.01))

_mixed = lambda s, d: mixed.mixed_model(_metrics(s, d), "mean_nni", ["sol"], "subject", ["sol"])
query("t23_mixed_model", digits=4)(lambda s, d: _mixed(s, d)[0])
query("t23_random_effects", digits=4)(lambda s, d: _mixed(s, d)[1])
LOF = _T + """, m AS (SELECT avg(mean_nni) AS m1, stddev_pop(mean_nni) AS s1, avg(sdnn) AS m2, stddev_pop(sdnn) AS s2, avg(rmssd) AS m3, stddev_pop(rmssd) AS s3 FROM f),
x AS (SELECT subject || ':' || sol AS id, subject, sol, mean_nni, sdnn, rmssd, (mean_nni - m1) / s1 AS x1, (sdnn - m2) / s2 AS x2, (rmssd - m3) / s3 AS x3 FROM f, m),
d AS (SELECT a.id AS p, b.id AS q, sqrt(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2) + pow(a.x3 - b.x3, 2)) AS d FROM x a JOIN x b ON a.id <> b.id), ne AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, q) <= 5),
kd AS (SELECT p, max(d) AS kd FROM ne GROUP BY p), ld AS (SELECT ne.p, 1 / (avg(greatest(d, kd)) + 1e-10) AS ld FROM ne JOIN kd ON kd.p = ne.q GROUP BY ne.p), lf AS (SELECT ne.p AS id, avg(b.ld) / any_value(a.ld) AS lof FROM ne JOIN ld a ON a.p = ne.p JOIN ld b ON b.p = ne.q GROUP BY ne.p)"""
_lof = lambda s, d: (lambda p: neighbours.local_outlier_factor(p[0], [f"z_{f}" for f in ("mean_nni", "sdnn", "rmssd")], 5))(cluster.prepare(_metrics(s, d), FEATURES))
query("t28_local_outlier_factor", LOF + " SELECT subject, sol, round(lof, 5) AS lof FROM lf JOIN x USING (id)", 5)(lambda s, d: _lof(s, d).select("subject", "sol", "lof"))
query("t28_local_outliers", LOF + ", o AS (SELECT *, lof > (SELECT quantile_disc(lof, 0.9) FROM lf) AS outlier FROM lf JOIN x USING (id)) SELECT outlier, count(*) AS n, round(avg(mean_nni), 4) AS mean_nni, round(avg(sdnn), 4) AS sdnn, round(avg(rmssd), 4) AS rmssd FROM o GROUP BY outlier", 4)(
    lambda s, d: _lof(s, d).groupBy("outlier").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("mean_nni", "sdnn", "rmssd")])
)

# H: bootstraps. Draws come from md5, which both engines have.

_AT = "CAST('0x' || substr(md5(concat_ws(':', {keys}, rep, p, '{seed}')), 1, 8) AS BIGINT) % n + 1"
_CI = lambda *names: ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{end}" for c in names for end, q in (("low", "0.025"), ("high", "0.975")))
query(
    "h23_bootstrap_intervals",
    f"""WITH {nn_sql()}, nz AS (SELECT subject, sol, i AS p, count(*) OVER (PARTITION BY subject, sol) AS n FROM nn), dr AS (SELECT subject, sol, rep, p, {_AT.format(keys='subject, sol', seed=3)} AS i FROM nz, range(1, 51) AS q(rep)),
x AS (SELECT subject, sol, rep, rr, rr - lag(rr) OVER w AS d, rr + lag(rr) OVER w AS s FROM dr JOIN nn USING (subject, sol, i) WINDOW w AS (PARTITION BY subject, sol, rep ORDER BY p)),
m AS (SELECT subject, sol, rep, stddev_samp(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd, 100 * avg(CASE WHEN abs(d) > 50 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS pnn50, stddev_pop(d) / sqrt(2) AS sd1, stddev_pop(s) / sqrt(2) AS sd2 FROM x GROUP BY subject, sol, rep)
SELECT subject, sol, {_CI('sdnn', 'rmssd', 'pnn50', 'sd1', 'sd2')} FROM m GROUP BY subject, sol""",
)(lambda s, d: linear.bootstrap_intervals(beats(s, d)))
query("h23_bootstrap_bands")(lambda s, d: linear.bootstrap_bands(beats(s, d, SUBJECT), SUBJECT))
query(
    "h24_bootstrap_balance",
    f"""WITH {nn_sql('subject')}, nz AS (SELECT subject, count(*) AS n, CASE WHEN count(*) < 100 THEN 50 WHEN count(*) < 1000 THEN 100 WHEN count(*) < 5000 THEN 150 ELSE 200 END AS reps, CASE WHEN count(*) > 1000 THEN 500 ELSE count(*) END AS m FROM nn GROUP BY subject HAVING count(*) >= 50),
dr AS (SELECT subject, m, rep, p, {_AT.format(keys='subject', seed=5)} AS i FROM nz, range(1, 201) AS q(rep), range(1, 1001) AS u(p) WHERE rep <= reps AND p <= m), x AS (SELECT subject, rep, p, m, rr, rr - lag(rr) OVER (PARTITION BY subject, rep ORDER BY p) AS d FROM dr JOIN nn USING (subject, i)),
st AS (SELECT subject, rep, avg(rr) AS a, stddev_samp(rr) AS sd, sqrt(avg(d * d)) AS step FROM x GROUP BY subject, rep), ft AS (SELECT subject, rep, k / any_value(m) AS f, pow(sum((rr / a - 1) * cos(2 * pi() * k * (p - 1) / m)), 2) + pow(sum((rr / a - 1) * sin(2 * pi() * k * (p - 1) / m)), 2) AS power
FROM x JOIN st USING (subject, rep), range(1, 101) AS g(k) WHERE m >= 100 AND k / m BETWEEN 0.01::DOUBLE AND 0.1::DOUBLE GROUP BY subject, rep, k), fb AS (SELECT subject, rep, sum(power) FILTER (f <= 0.04::DOUBLE) AS lo, sum(power) FILTER (f >= 0.04::DOUBLE) AS hi FROM ft GROUP BY subject, rep),
r AS (SELECT subject, sd / a AS cv, least(15.0::DOUBLE, greatest(0.1::DOUBLE, CASE WHEN hi > 1e-18 THEN lo / hi WHEN step > 0 THEN sd / step ELSE 1 END)) AS lf_hf FROM st LEFT JOIN fb USING (subject, rep)), c AS (SELECT subject, lf_hf, least(1, lf_hf / 5) AS sympathovagal, least(1, 15 * cv) AS complexity FROM r)
SELECT subject, {_CI('lf_hf', 'sympathovagal', 'complexity')} FROM c GROUP BY subject UNION ALL SELECT subject, 0, 0, 0, 0, 0, 0 FROM nn GROUP BY subject HAVING count(*) < 50""",
)(lambda s, d: linear.bootstrap_balance(beats(s, d, SUBJECT), SUBJECT))
