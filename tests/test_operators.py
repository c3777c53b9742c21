"""Closed-form fixtures, numpy recomputation and invariants."""

import json
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import dist
from pulseloom.operators.density import density
from pulseloom.operators import align, clean, cluster, forecast, hrv, rr, stats, timeagg
from pulseloom.plans import catalog
from pulseloom.sources import files
from pulseloom.streaming.live import windowed_heart_rate

KEY = ("subject",)


def beats(spark, values, subject="a"):
    return spark.createDataFrame([(subject, i + 1, float(v)) for i, v in enumerate(values)], "subject string, i int, rr double")


def test_distributions_against_tables():
    assert np.allclose(dist.t_two_sided([2.228, 1.96, 12.706], [10, 1e6, 1]), [0.05, 0.05, 0.05], atol=2e-4)
    assert np.allclose(dist.f_upper([4.9646, 3.0], [1, 5], [10, 1000]), [0.05, 0.01083], atol=2e-4)
    assert np.allclose(dist.chi2_upper([3.841, 18.307, 0.0], [1, 10, 3]), [0.05, 0.05, 1.0], atol=2e-4)
    assert abs(dist.normal_quantile(0.975) - 1.959964) < 1e-6


def test_sixty_bpm_is_a_second(spark):
    s = spark.createDataFrame([("a", 1, float(t), t, h) for t, h in enumerate([60.0, 70.0, 80.0, 65.0, 75.0, None, -10.0, 300.0])], "subject string, sol int, t double, seq int, hr double")
    got = rr.compute_rr(s).orderBy("i").collect()
    assert got[0]["rr"] == 1000.0 and len(got) == 5 and all(300 <= r["rr"] <= 2000 for r in got)
    assert rr.conversion_info(s).first()["n_filtered"] == 3


def test_dirty_heart_rate(spark):
    s = spark.createDataFrame([(v,) for v in (70.0, 80.0, 300.0, None, -10.0, 90.0, 85.0)], "hr double")
    assert sorted(r[0] for r in s.select(clean.range_null(F.col("hr"))).collect() if r[0] is not None) == [70.0, 80.0, 85.0, 90.0]


def test_stage_counts_fall(spark):
    rnd = np.random.default_rng(1)
    s = spark.createDataFrame([("a", 1, float(i), i, float(v) if v > 40 else None) for i, v in enumerate(rnd.normal(80, 25, 300))], "subject string, sol int, t double, seq int, hr double")
    c = clean.stage_counts(clean.quality_pipeline(s)).first()
    assert c["n_total"] >= c["n_present"] >= c["n_in_range"] >= c["n_typical"] >= c["n_steady"] > 0


def test_constant_beats(spark):
    b = beats(spark, [800] * 60)
    t = hrv.time_domain(b, KEY).first()
    assert (t["sdnn"], t["rmssd"], t["pnn50"], t["mean_hr"]) == (0.0, 0.0, 0.0, 75.0)
    assert hrv.poincare(b, KEY).first()["sd1"] == 0.0 and hrv.stress_index(b, KEY).first()["stress_index"] == 0.0


def test_malik_finds_the_artifact(spark):
    b = beats(spark, [800, 820, 1200, 815, 805, 800, 810, 805, 800, 810])
    assert [r["i"] for r in rr.malik(b, KEY).where("artifact").collect()] == [3]
    assert [r["i"] for r in rr.clean_rr(b, "malik", KEY).orderBy("i").collect()] == list(range(1, 10))
    assert rr.malik(beats(spark, [800, 820, 1200, 815, 805]), KEY).where("artifact").count() == 0


def test_two_tones_have_both_bands(spark):
    t = np.linspace(0, 300, 600)
    b = beats(spark, 800 + 20 * np.sin(2 * np.pi * 0.1 * t) + 10 * np.sin(2 * np.pi * 0.25 * t))
    f = hrv.frequency_domain(b, KEY).first()
    assert f["lf_power"] > 0 and f["hf_power"] > 0 and math.isclose(f["lf_nu"] + f["hf_nu"], 100, abs_tol=1e-9)


def test_psd_against_numpy(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(800, 50, 400)
    mid = np.cumsum(v) / 1000 - v / 2000
    grid = np.arange(0, v.sum() / 1000, 0.25)
    x = np.interp(grid, mid, v)
    lo, hi = grid < mid[0], grid > mid[-1]
    x[lo] = v[0] + (grid[lo] - mid[0]) / (mid[1] - mid[0]) * (v[1] - v[0])
    x[hi] = v[-2] + (grid[hi] - mid[-2]) / (mid[-1] - mid[-2]) * (v[-1] - v[-2])
    x = x - np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x)))
    m = min(len(x) // 4, 256)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    step = m - m // 2
    p = np.mean([np.abs(np.fft.rfft((x[s : s + m] - x[s : s + m].mean()) * w)) ** 2 for s in range(0, len(x) - m + 1, step)], axis=0) / (4 * (w**2).sum())
    p[1 : -1 if m % 2 == 0 else None] *= 2
    got = {r["k"]: r["power"] for r in hrv.psd(beats(spark, v), KEY).collect()}
    assert len(got) > 20 and all(math.isclose(got[k], p[k], rel_tol=1e-8, abs_tol=1e-8) for k in got)


def test_dfa_against_numpy(spark):
    v = np.random.default_rng(3).normal(800, 50, 300)
    y = np.cumsum(v - v.mean())

    def alpha(scales):
        f = []
        for s in scales:
            n = len(y) // s
            f.append(np.mean([np.sqrt(np.mean((y[k * s : k * s + s] - np.polyval(np.polyfit(np.arange(s), y[k * s : k * s + s], 1), np.arange(s))) ** 2)) for k in range(n)]))
        return np.polyfit(np.log10(scales), np.log10(f), 1)[0]

    got = hrv.dfa(beats(spark, v), KEY).first()
    assert math.isclose(got["dfa_alpha1"], alpha(range(4, 17)), rel_tol=1e-9) and math.isclose(got["dfa_alpha2"], alpha(range(16, 65)), rel_tol=1e-9)


def test_entropy_against_numpy(spark):
    v = np.random.default_rng(4).normal(800, 50, 120)
    r = 0.2 * v.std()

    def phi(m):
        t = np.array([v[i : i + m] for i in range(len(v) - m + 1)])
        c = (np.abs(t[:, None] - t[None]).max(2) <= r).sum(1)
        return np.mean(np.log(c / len(t)))

    assert math.isclose(hrv.entropy(beats(spark, v), KEY).first()["sample_entropy"], phi(2) - phi(3), rel_tol=1e-9)


def test_bounds(spark):
    b = beats(spark, np.random.default_rng(5).normal(800, 50, 260))
    a = hrv.ans_balance(b, KEY).first()
    assert 0 <= a["sympathovagal_index"] <= 1 and 0 <= a["cardiac_autonomic_balance"] <= 1 and 0 <= a["autonomic_reactivity"] <= 1 and 0 <= a["baroreflex_sensitivity"] <= 20
    t = hrv.time_domain(b, KEY).first()
    assert t["pnn50"] <= t["pnn20"]


def test_resampling_and_smoothing(spark):
    b = beats(spark, [800, 820, 810, 815, 805, 825, 800])
    for how in ("linear", "cubic"):
        x = [r["x"] for r in rr.resample(b, KEY, how=how).collect()]
        assert x and all(v is not None and 790 < v < 835 for v in x)
    noisy = beats(spark, 800 + 50 * np.sin(4 * np.pi * np.arange(100) / 99) + np.random.default_rng(6).normal(0, 10, 100))
    for how in ("savgol", "median", "lowpass"):
        d = rr.smooth(noisy, how, KEY, window=7).where("smooth is not null").agg(F.stddev_samp(F.col("smooth") - F.col("rr")).alias("d"), F.count("*").alias("n")).first()
        assert d["n"] == 94 and 0 < d["d"] < 30
    with pytest.raises(ValueError):
        rr.smooth(noisy, "other", KEY)


def test_signal_quality_orders(spark):
    good, bad = beats(spark, np.random.default_rng(7).normal(800, 50, 200)), beats(spark, [800] * 50, "b")
    s = {r["subject"]: r for r in rr.signal_quality(good.union(bad), KEY).collect()}
    assert s["a"]["score"] > s["b"]["score"] and s["b"]["rmssd"] == 0


def test_adjusted_p_against_a_table(spark):
    d = spark.createDataFrame([("m", p) for p in (0.01, 0.04, 0.03, 0.005)], "metric string, p_value double")
    got = {r["p_value"]: (r["p_bonferroni"], r["p_bh"]) for r in stats.adjust(d, ["metric"]).collect()}
    assert math.isclose(got[0.005][1], 0.02) and math.isclose(got[0.04][1], 0.04) and math.isclose(got[0.03][0], 0.12)


def test_bootstrap_holds_the_mean(spark):
    v = np.random.default_rng(8).normal(100, 15, 300)
    d = spark.createDataFrame([("m", "g", i, float(x)) for i, x in enumerate(v)], "metric string, grp string, id long, value double")
    b = stats.bootstrap(d, F.avg, reps=200).first()
    assert b["low"] < b["estimate"] < b["high"] and 2 < b["high"] - b["low"] < 5
    two = d.union(d.select("metric", F.lit("h"), "id", F.col("value") + 10))
    assert stats.permutation(two, "g", "h", reps=200).first()["p_value"] < 0.05
    assert stats.bootstrap(d, lambda c: F.percentile(c, F.lit(0.5)), reps=20).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_resampling_queries_have_the_references_repetitions(spark):
    sf = "/root/testdata/sf0.001"
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount").collect()
    values = lambda metric, grp: np.array([r[metric] for r in li if r["l_returnflag"] == grp])
    b = {(r["metric"], r["grp"]): r for r in catalog.QUERIES["t16_bootstrap"](spark, sf).collect()}
    p = {r["metric"]: r for r in catalog.QUERIES["t18_permutation"](spark, sf).collect()}
    assert set(p) == {"l_quantity", "l_discount"} and len(b) == 6
    for (metric, grp), r in b.items():
        v = values(metric, grp)
        assert math.isclose(r["estimate"], v.mean(), abs_tol=1e-6) and abs((r["high"] - r["low"]) / (2 * 1.959964 * v.std() / math.sqrt(len(v))) - 1) < 0.15
    for metric, r in p.items():
        x, y = (values(metric, g) for g in "AR")
        z = (x.mean() - y.mean()) / math.sqrt(x.var() / len(x) + y.var() / len(y))
        assert abs(r["p_value"] - math.erfc(abs(z) / math.sqrt(2))) < 0.02 and math.isclose(r["p_value"] * 10_000, round(r["p_value"] * 10_000), abs_tol=1e-6)
    assert any(not math.isclose(r["p_value"] * 50, round(r["p_value"] * 50), abs_tol=1e-6) for r in p.values())
    d = spark.createDataFrame([("m", g, float(i % 40) + 2.4 * (g == "h")) for g in "gh" for i in range(320)] + [("m", "h", None)], "metric string, grp string, value double")
    one = stats.permutation(d, "g", "h").first()
    assert 0 < one["p_value"] < 0.02 and stats.permutation(d.repartition(7), "g", "h").first()["p_value"] == one["p_value"]
    assert stats.permutation(d.where("false"), "g", "h").count() == 0


def test_choose_k_finds_six_clusters(spark):
    rng = np.random.default_rng(2)
    at = [(20 * math.cos(a), 20 * math.sin(a)) for a in np.arange(6) * math.pi / 3]
    d = spark.createDataFrame([(float(x + rng.normal()), float(y + rng.normal())) for x, y in at for _ in range(20)], "x double, y double").coalesce(1)
    p, kept = cluster.prepare(d, ["x", "y"])
    got = cluster.choose_k(p, kept).collect()
    assert [r["k"] for r in got] == list(range(2, 11)) and sum(r["votes"] for r in got) == 4
    assert max(got, key=lambda r: r["votes"])["k"] == 6


def test_merge_and_positions(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "subject string, v int")
    got = align.merge_external(a, {"sleep": spark.createDataFrame([("x", 7)], "subject string, v int"), "none": spark.createDataFrame([(1,)], "k int")})
    assert got.columns == ["subject", "v", "v_sleep"] and got.where("v_sleep is null").count() == 1


def test_series_models(spark):
    rows = [(s, i, 50 + 0.5 * i * k + 5 * math.sin(2 * math.pi * i / 12)) for k, s in enumerate("abc") for i in range(60)]
    d = spark.createDataFrame(rows, "series_id string, i long, y double")
    f = forecast.seasonal_regression(d).where("series_id = 'b'").orderBy("i").collect()
    assert all(abs(r["forecast"] - (50 + 0.5 * r["i"] + 5 * math.sin(2 * math.pi * r["i"] / 12))) < 1e-6 for r in f)
    assert {r["trend"] for r in forecast.adaptation(d).where("series_id = 'c'").collect()} == {"increasing"}
    assert forecast.autoregression(d).count() == 3 and forecast.pooled(d).count() == 3
    s = {r["series_id"]: r for r in forecast.adf(d).join(forecast.kpss(d), "series_id").collect()}
    assert not s["c"]["kpss_stationary"]


def test_partial_autocorrelation(spark):
    x, rnd = [0.0], np.random.default_rng(9)
    for _ in range(1999):
        x.append(0.7 * x[-1] + rnd.normal())
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "subject string, i long, x double")
    p = {r["lag"]: r["pacf"] for r in timeagg.partial_autocorrelation(timeagg.autocorrelation(d, KEY, lags=5), KEY).collect()}
    assert p[0] == 1 and abs(p[1] - 0.7) < 0.06 and abs(p[2]) < 0.06


def test_density_clusters(spark):
    rows = [(i, 0.1 * (i % 5), 0.1 * (i // 5)) for i in range(25)] + [(100 + i, 10 + 0.1 * (i % 5), 0.1 * (i // 5)) for i in range(25)] + [(999, 5.0, 5.0)]
    d = density(spark.createDataFrame(rows, "id0 long, x double, y double"), ["x", "y"], 0.25, 4, "id0")
    assert sorted(r["count"] for r in d.groupBy("cluster").count().collect()) == [1, 25, 25]


def test_csv_folder(spark, tmp_path):
    for sol, subject, sep, head in ((2, "T01_Anna", ",", "time [s/1000],heart_rate [bpm](/api/datatype/19/)"), (3, "T02_Bo", ";", "time [s/256];heart_rate [bpm](/api/datatype/19/);activity [g](/api/x/)")):
        at = tmp_path / f"Sol {sol} (completo)" / subject
        at.mkdir(parents=True)
        (at / "r.csv").write_text(head + "\n" + "\n".join(sep.join(str(256000 * k + c) for c in range(head.count(sep) + 1)) for k in range(3)) + "\n")
    found = files.discover(spark, str(tmp_path))
    assert sorted((r["sol"], r["subject"]) for r in found.collect()) == [(2, "T01_Anna"), (3, "T02_Bo")]
    assert files.missing_files(found).count() == 2
    d = files.to_canonical(files.read_csvs(spark, [r["path"] for r in found.orderBy("sol").collect()]))
    got = {(r["subject"], r["Sol"], r["time_seconds"]) for r in d.collect()}
    assert ("T01_Anna", 2, 256.0) in got and ("T02_Bo", 3, 1000.0) in got and d.count() == 6
    assert files.snake_header("heart_rate [bpm](/api/datatype/19/)") == "heart_rate_bpm" and files.normalise_header("a [b](/api)") == "a [b]"


def test_wav_folder(spark, tmp_path):
    pcm = struct.pack("<8h", 1, -1, 2, -2, 3, -3, 4, -4)
    head = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 4, 16, 4, 16) + b"data" + struct.pack("<I", len(pcm))
    (tmp_path / "ecg.wav").write_bytes(head + pcm)
    got = sorted((r["channel"], r["i"], r["t"], r["value"]) for r in files.read_wavs(spark, str(tmp_path)).collect())
    assert got[:2] == [(0, 0, 0.0, 1.0), (0, 1, 0.25, 2.0)] and got[-1] == (1, 3, 0.75, -4.0)


def test_csv_shapes(spark, tmp_path):
    texts = {"a": "x;y\n1;2\n3;4\n".encode(), "b": "x\té\n1\t2\n\n3\t4\n".encode("latin1"), "c": b"x|y\n1|2\n", "d": b"", "e": '"x;1",y\n1,2\n3,4\n'.encode()}
    for name, content in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    got = {r["path"][-5]: (r["encoding"], r["sep"], r["header"]) for r in files.probe_csvs(spark, [str(tmp_path / f"{n}.csv") for n in texts]).collect()}
    assert got["a"] == ("UTF-8", ";", ["x", "y"]) and got["b"] == ("ISO-8859-1", "\t", ["x", "é"]) and got["c"][2] == [] and "d" not in got and got["e"][:2] == ("UTF-8", ",")


def test_recordings_have_times(spark, tmp_path):
    pcm = struct.pack("<4h", 1, 2, 3, 4)
    wav = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 4, 8, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    infos = {"one (1)": '{"timestamp": 1704067200.5, "start_date": "2024-01-01", "user": 7, "devices": ["a", "b"]}', "two": '{"timestamp": -3}', "three": "{broken", "four": None}
    for name, info in infos.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name[:3]}.wav").write_bytes(wav)
        if info:
            (tmp_path / name / "info.json").write_text(info)
    got = {(r["signal_id"], r["i"]): r for r in files.read_recordings(spark, str(tmp_path)).withColumn("us", F.unix_micros("ts")).collect()}
    assert len(got) == 16
    r = got["one.wav", 3]
    assert (r["us"], r["start_date"], r["user"], r["devices"]) == (1704067201250000, "2024-01-01", "7", "a, b")
    assert all(got[f"{n}.wav", 0]["us"] is None for n in ("two", "thr", "fou"))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 0.0, 60.0), ("b", 1, 1.0, 61.0)], "subject string, sol int, t double, hr double")
    files.write_samples(d, str(tmp_path / "p"))
    files.write_metrics(d, str(tmp_path / "j"), "json")
    assert spark.read.parquet(str(tmp_path / "p")).where("subject = 'b'").count() == 1
    lines = [x for p in (tmp_path / "j").glob("part*.json") for x in p.read_text().splitlines()]
    assert [json.loads(x)["sol"] for x in lines] == [1, 1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", 60.0 + m) for m in range(0, 50, 5)]
    d = spark.createDataFrame(rows, "subject string, ts string, hr double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = windowed_heart_rate(s).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, windowed_heart_rate(d).collect()))
    assert sorted(map(tuple, spark.table("live").collect())) == want and len(want) == 5


def test_least_squares_against_numpy(spark):
    from pulseloom.operators import models

    rnd = np.random.default_rng(10)
    x = rnd.normal(size=(200, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rnd.normal(0, 0.5, 200)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = {r["term"]: r for r in models.ols(d, "y", ["a", "b"]).collect()}
    m = np.column_stack([np.ones(200), x])
    beta, sse, *_ = np.linalg.lstsq(m, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * sse[0] / 197)
    for k, t in enumerate(("intercept", "a", "b")):
        assert math.isclose(got[t]["coef"], beta[k], rel_tol=1e-9) and math.isclose(got[t]["se"], se[k], rel_tol=1e-9)
    assert math.isclose(got["a"]["r2"], 1 - sse[0] / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    assert all(0.9 < r["vif"] < 1.2 for r in models.inflation(d, ["a", "b"]).collect())
    assert models.mahalanobis_outliers(d, ["a", "b"]).where("outlier").count() == pytest.approx(20, abs=3)


def test_normality_tells_normal_from_skewed(spark):
    from pulseloom.operators import models

    rnd = np.random.default_rng(11)
    rows = [("m", "normal", float(v)) for v in rnd.normal(5, 2, 500)] + [("m", "skewed", float(v)) for v in rnd.exponential(2, 500)]
    d = spark.createDataFrame(rows, "metric string, grp string, value double")
    for f, name, less in ((models.ks_normal, "d", True), (models.anderson_darling, "a2", True), (models.shapiro_francia, "w_prime", False)):
        got = {r["grp"]: r[name] for r in f(d).collect()}
        assert (got["normal"] < got["skewed"]) == less
    assert {r["grp"]: r["w_prime"] for r in models.shapiro_francia(d).collect()}["normal"] > 0.98


def test_segment_intervals_hold_the_value(spark):
    from pulseloom.operators import models

    b = beats(spark, np.random.default_rng(12).normal(800, 50, 200))
    i, t = models.bootstrap_intervals(b, KEY).first(), hrv.time_domain(b, KEY).first()
    assert i["sdnn_low"] < t["sdnn"] < i["sdnn_high"]
