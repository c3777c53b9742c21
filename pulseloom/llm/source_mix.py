"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate, drawn from its id and a seed, over its quality weight; the smallest keys
come first. Each source first takes whole epochs of all its documents; the rest of its budget goes to the documents in
key order whose running sum of sizes reaches it. The running sum is two-level: exact sums per (source, key slice) come
first, and only a slice is ever sorted in one task: 1/SLICES of a source, or less where that would be more than SLICE_ROWS, so a
source with a third of all rows is no hot spot. What goes back from sources to documents is one row per source, joined without a
forced broadcast.

Defined results: a null text has size 0; null sources are one source, the last; a source without words has target 0 and
takes 0; ties in the key go by id, size; a null id draws its key from the text; repeated rows are documents of
their own; no documents give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import documents, free_name, settle, word_count

SLICES = 1024
SLICE_ROWS = 1_000_000
MOST = 3  # times that a document may be taken, and a source's size that its target may reach


def source_targets(sizes: DataFrame, total_share: float = 1.0, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, size): water filling of total_share x all sizes.

    Weights 1, 2, 3, repeating over the sources by code point, null last. A target stops at most x its source's size and
    the excess is shared anew by weight: with sources sorted by size / weight, those below the final level are full.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total_share))})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level)
    # The first source that its own level doesn't fill sets the level of all after it.
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    s = s.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def exponential_key(drawn_from: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality with u from 52 bits of md5(seed:string)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), drawn_from)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / quality


def mix(rows: DataFrame, seed: int = 17, slices: int | None = None, most: int = MOST) -> DataFrame:
    """Adds source_size, target and taken to rows with columns doc_id, draw, source, size and quality (over 0), and drops draw."""
    keyed = settle(rows.withColumn("key", exponential_key(F.col("draw"), F.col("quality"), seed)).drop("draw"))
    slices = slices or max(SLICES, -(-keyed.count() // SLICE_ROWS))
    # 1 - exp(-key) spreads the keys of documents of quality 1 evenly over the slices and keeps the order.
    keyed = keyed.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * slices), F.lit(slices - 1)).cast("int"))
    parts = keyed.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.withColumnRenamed("part", "size"))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    targets = targets.withColumn("left", F.when(F.col("epochs") >= most, F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    below = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("part").over(below), F.lit(0))).select(F.col("source").alias("s"), F.col("slice").alias("b"), "below")
    targets = targets.withColumnRenamed("source", "t")
    plan = parts.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    within = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("b")))
    # The document in which the budget ends is taken if its middle is within it.
    chosen = (F.col("below") + F.col("ahead") + F.col("size") / 2.0 <= F.col("left")) & (F.col("left") > 0)
    return joined.withColumn("copies", F.col("epochs") + F.when(chosen, 1).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size")).drop("s", "b", "below", "ahead", "key", "slice", "epochs", "left")


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """doc_id, quality: good or bad by the mean of a document's quality labels, one row per id."""
    found = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.avg("quality").alias("q"))
    return found.select("label_id", F.when(F.col("q") >= 0.5, good).otherwise(bad).alias("quality"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Joins quality to docs; documents without a label weigh 1."""
    rows = docs.join(quality_weights(labels), docs["doc_id"] == F.col("label_id"), "left").drop("label_id")
    return rows.withColumn("quality", F.coalesce("quality", F.lit(1.0)))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, draw (what a document's key is drawn from), and more columns."""
    draw = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), *more)


def repeat_to_targets(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Rows alike in all columns come as often as they are taken together."""
    row_hash, plan_hash, plan_id, copies, times = (free_name(docs, f"pl_{x}") for x in ("row", "hash", "id", "copies", "times"))
    whole = F.xxhash64(*[docs[c] for c in docs.columns])
    plan = mix(with_quality(sized(docs, whole.alias("row_hash")), labels), seed)
    plan = settle(plan.groupBy(F.col("doc_id").alias(plan_id), F.col("row_hash").alias(plan_hash)).agg(F.sum("copies").alias(copies), F.count("*").alias(times)))
    out = docs.withColumn(row_hash, whole)
    if not plan.where(F.col(times) > 1).isEmpty():
        out = out.dropDuplicates([*docs.columns])
    out = out.join(plan.where(F.col(copies) > 0), docs["doc_id"].eqNullSafe(F.col(plan_id)) & (F.col(row_hash) == F.col(plan_hash)))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[docs[c] for c in docs.columns])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mix(with_quality(sized(documents(spark, sf_dir)), labels))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


OP10_SQL = r"""
WITH q AS (SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, coalesce(CAST(d.doc_id AS VARCHAR), '#' || md5(coalesce(text, ''))) AS draw, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(q.quality, 1.0::DOUBLE) AS quality FROM documents d LEFT JOIN q USING (doc_id)),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5('17:' || draw), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / quality AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS rn
      FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT arg_min(level, rn) AS final FROM l WHERE level * weight < cap),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, CASE WHEN epochs >= 3 THEN 0 ELSE target - epochs * source_size END AS rest,
      coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
