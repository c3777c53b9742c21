"""A corpus from raw documents: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage works on all that its predecessor kept; run() writes each one's result as Parquet and reads it again, and removes what
the next has read. Near-dedup takes shingles of five words and a similarity of 0.8.

Defined results: a null or empty text has too few words and goes with the first stage; null ids, sources and languages are kept as
they are; rows that share an id are documents of their own, exact copies among them leave one with the second stage; extra columns
stay until the last stage, which returns digests; an empty benchmark removes nothing, empty labels make all weigh the same, no
documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm.common import documents, remove, settle
from pulseloom.llm.decontamination import without_leaks
from pulseloom.llm.minhash_dedup import without_near_copies
from pulseloom.llm.quality_rules import keep_good
from pulseloom.llm.sharding import shard_digests
from pulseloom.llm.source_mix import repeat_to_targets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return repeat_to_targets(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_digests(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("source mix", mix), ("sharding", shard)]

#: Near-dedup and decontamination are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = documents(spark, sf_dir), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, spent = spent, []
            docs = settle(docs, spent)
            remove(spark, before)
    return docs
