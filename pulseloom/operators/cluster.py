"""Clustering of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.lineage import remove
from pulseloom.operators import kmeans as many


def prepare(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Features filled with their median and standardised (ddof 0) as z_<feature>; constant ones are left out. One aggregation."""
    s = df.agg(*[F.struct(F.percentile(f, F.lit(0.5)).alias("med"), F.avg(F.coalesce(F.col(f), F.lit(None))).alias("m")).alias(f) for f in features]).first()
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(s[f]["med"])) for f in features if s[f]["med"] is not None})
    used = [f for f in features if s[f]["med"] is not None]
    t = filled.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("sd")).alias(f) for f in used]).first()
    kept = [f for f in used if t[f]["sd"]]
    return filled.withColumns({f"z_{f}": (F.col(f) - t[f]["m"]) / t[f]["sd"] for f in kept}), kept


def _vector(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"z_{f}" for f in kept], outputCol="features").transform(df)


def kmeans(df: DataFrame, kept: Sequence[str], k: int, seeds: Sequence[int] = range(1, 11)) -> DataFrame:
    """cluster of the best of several starts by inertia, all of which move in the same passes; null where a feature is null or NaN."""
    trash, z = [], [f"z_{f}" for f in kept]
    best = many.search(many.points(df, z, trash), [k], list(seeds))
    remove(df.sparkSession, trash)
    return df.withColumn("cluster", many.nearest(best[k], z) if best else F.lit(None).cast("int"))


def bisecting(df: DataFrame, kept: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """Top-down hierarchical clusters."""
    v = _vector(df, kept)
    return BisectingKMeans(k=k, seed=seed).fit(v).transform(v).withColumnRenamed("prediction", "cluster").drop("features")


def validate(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of labelled rows, by group sums."""
    z = [f"z_{f}" for f in kept]
    c = df.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f).alias(f"c_{f}") for f in z])
    all_ = df.agg(F.count("*").alias("total"), *[F.avg(f).alias(f"g_{f}") for f in z])
    dist = F.lit(0.0)
    for f in z:
        dist = dist + (F.col(f) - F.col(f"c_{f}")) ** 2
    inner = df.join(F.broadcast(c), "cluster").groupBy("cluster").agg(F.sum(dist).alias("w"), F.avg(F.sqrt(dist)).alias("s"))  # one row per cluster
    between = F.lit(0.0)
    for f in z:
        between = between + (F.col(f"c_{f}") - F.col(f"g_{f}")) ** 2
    t = c.join(all_).join(inner, "cluster")
    ch = t.agg(F.count("*").alias("k"), F.max("total").alias("total"), F.sum(F.col("n") * between).alias("b"), F.sum("w").alias("w"))
    a, b = t.alias("a"), t.alias("b")
    apart = F.lit(0.0)
    for f in z:
        apart = apart + (F.col(f"a.c_{f}") - F.col(f"b.c_{f}")) ** 2
    db = a.join(b, F.col("a.cluster") != F.col("b.cluster")).select(F.col("a.cluster").alias("x"), ((F.col("a.s") + F.col("b.s")) / F.sqrt(apart)).alias("r")).groupBy("x").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.select("k", (F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("total") - F.col("k")))).alias("calinski_harabasz"), F.col("w").alias("inertia")).join(db)


def choose_k(df: DataFrame, kept: Sequence[str], ks: Sequence[int] = range(2, 11), seeds: Sequence[int] = range(1, 11)) -> DataFrame:
    """k, silhouette, calinski_harabasz, davies_bouldin, inertia and votes for each k below the number of rows; the elbow, the greatest
    second difference of inertia, votes too. All k and starts move in the same passes; two more passes measure the best of every k."""
    spark, trash = df.sparkSession, []
    d = many.points(df, [f"z_{f}" for f in kept], trash)
    n = d.agg(F.sum("n")).first()[0] or 0
    best = many.search(d, [k for k in ks if k < n], list(seeds)) if n > min(ks) else {}
    rows = [(k, v["silhouette"], v["calinski_harabasz"], v["davies_bouldin"], v["inertia"]) for k, v in zip(best, many.measures(d, list(best.values())), strict=True)] if best else []
    remove(spark, trash)
    votes = []
    for column, turn in ((1, 1), (2, 1), (3, -1)):
        scored = [r for r in rows if r[column] is not None]
        votes += [max(scored, key=lambda r: turn * r[column])[0]] if scored else []
    bends = [(a[4] - 2 * b[4] + c[4], b[0]) for a, b, c in zip(rows, rows[1:], rows[2:], strict=False)]
    votes += [max(bends)[1]] if bends else votes[:1]
    return spark.createDataFrame([(*r, votes.count(r[0])) for r in rows], "k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double, votes int")


def profiles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Size and mean of each feature per cluster."""
    return df.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def importance(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """feature, importance: variance of the cluster means on scaled data."""
    means = df.groupBy("cluster").agg(*[F.avg(f"z_{f}").alias(f) for f in kept])
    return means.agg(*[F.var_pop(f).alias(f) for f in kept]).unpivot([], list(kept), "feature", "importance")


def assign(df: DataFrame, centres: DataFrame, features: Sequence[str]) -> DataFrame:
    """The nearest centre (cluster, features) of each row: centres are few and go along as one array."""
    arr = centres.agg(F.collect_list(F.struct("cluster", F.array(*[F.col(f).cast("double") for f in features]).alias("c"))).alias("centres"))
    at = F.array(*[F.col(f).cast("double") for f in features])
    far = lambda c: F.aggregate(F.zip_with(c["c"], at, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = F.array_min(F.transform("centres", lambda c: F.struct(far(c).alias("d"), c["cluster"].alias("cluster"))))
    return df.join(F.broadcast(arr)).withColumn("near", near).select("*", F.col("near.cluster").alias("nearest"), F.sqrt("near.d").alias("distance")).drop("centres", "near")  # one row of centres


# Indicators of autonomic patterns; for low_variability the sign turns.
INDICATORS = {
    "parasympathetic": ("rmssd", "pnn50", "hf_power", "hf_nu", "sd1"),
    "sympathetic": ("lf_nu", "lf_hf_ratio", "mean_hr", "stress_index"),
    "balanced": ("sdnn", "total_power", "vlf_power"),
    "low_variability": ("sdnn", "rmssd", "total_power"),
}


def phenotypes(profile: DataFrame) -> DataFrame:
    """cluster, n and the pattern of greatest mean indicator; the first named wins a tie, absent ones count 0."""
    scores = []
    for name, wish in INDICATORS.items():
        have = [F.col(c) for c in wish if c in profile.columns]
        mean = sum(have[1:], have[0]) / len(have) if have else F.lit(0.0)
        scores.append((name, -mean if name == "low_variability" else mean))
    top, label = F.greatest(*[s for _, s in scores]), F.lit(None).cast("string")
    for name, s in reversed(scores):
        label = F.when(s == top, name).otherwise(label)
    return profile.withColumn("phenotype", label)


def balance_rule(lf_hf: Column) -> Column:
    """sympathetic from 1.8 on, parasympathetic up to 1.0, else balanced."""
    return F.when(lf_hf >= 1.8, "sympathetic").when(lf_hf <= 1.0, "parasympathetic").otherwise("balanced")
