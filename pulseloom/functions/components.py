"""Connected components by alternating large and small stars: the number of rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.lineage import remove, settle


def _large(e: DataFrame) -> DataFrame:
    """Every node's greater neighbours are tied to the least of the node and its neighbours."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, trash: list[str]) -> DataFrame:
    """node, root: the least node that each linked node can reach, itself included. links has two columns of one type that can be ordered.

    Each round is settled; what it replaces is removed. Links to oneself, nulls and repeated links change nothing.
    """
    a, b = links.columns
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    mine: list[str] = []
    e, before = settle(e, mine), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, old = state, list(mine)
        mine.clear()
        e = settle(_small(_large(e)), mine)
        remove(links.sparkSession, old)
    trash.extend(mine)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
