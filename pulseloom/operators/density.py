"""Density clusters in any number of dimensions without pairs of all points of a dense place.

Distinct places with their counts lie in cells whose diagonal is eps, so a cell's points are all neighbours: a cell of `least` rows
is all core without a comparison, and a cell's core points are one node. Only points of sparser cells are compared, with the cells in
reach, which is a number of comparisons that grows with the rows. Two cells of many core points are compared through ever finer
parts, of which one point stands for each, until a pair within eps is found or all parts are too far.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.components import components
from pulseloom.functions.lineage import remove, settle

#: Core points of two cells that are compared directly up to so many pairs; how often parts are cut in four along each dimension.
DIRECT, CUTS = 4096, 3


def _apart(a: str, b: str) -> Column:
    """The squared distance of two array columns."""
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _gap(a: str, b: str, side: float) -> Column:
    """The least squared distance of points of two cells."""
    part = lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double") * side
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: part(x, y) * part(x, y)), F.lit(0.0), lambda s, v: s + v)


def _cell(at: Column, side: float) -> Column:
    return F.transform(at, lambda x: F.floor(x / side))


def density(df: DataFrame, features: Sequence[str], eps: float, least: int, key: str) -> DataFrame:
    """df with cluster: the least key of the cluster's core rows as text, -1 for noise.

    Core rows have `least` rows or more within eps, themselves included; core rows within eps of each other share a cluster; other rows
    within eps of core rows take the least of their clusters. Rows with a null or NaN feature are noise. Rows of one place count each.
    """
    spark, trash, top = df.sparkSession, [], eps * eps
    width = len(features)
    side = eps / math.sqrt(width) * (1 - 1e-9)
    reach = math.floor(math.sqrt(width) * (1 + 1e-8)) + 1
    near_top = top * (1 + 1e-9)
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    placed = df.withColumn("at_", F.when(whole, F.array(*[F.col(f).cast("double") + 0.0 for f in features])))
    p = placed.where("at_ is not null").groupBy(F.col("at_").alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("id"))
    p = settle(p.withColumn("cell", _cell(F.col("at"), side)), trash)
    cells = settle(p.groupBy("cell").agg(F.sum("n").alias("m")), trash)

    # Pairs of occupied cells in reach, both ways, a cell with itself too.
    coarse = F.transform("cell", lambda c: F.floor(c / reach))
    around = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in itertools.product((-1, 0, 1), repeat=width)])
    other = cells.select(F.col("cell").alias("other"), F.col("m").alias("other_m"), F.explode(F.transform(around, lambda o: F.zip_with(coarse, o, lambda a, b: a + b))).alias("coarse"))
    near = settle(cells.withColumn("coarse", coarse).join(other, "coarse").where(_gap("cell", "other", side) <= near_top).drop("coarse"), trash)

    sparse = p.join(cells, "cell").where(F.col("m") < least)
    asks = settle(sparse.join(near.select("cell", "other"), "cell").select("id", "at", "m", "cell", "other"), trash)
    seen = p.select(F.col("cell").alias("other"), F.col("at").alias("to"), F.col("n").alias("to_n"))
    counts = asks.where("cell <> other").join(seen, "other").where(_apart("at", "to") <= top).groupBy("id").agg(F.sum("to_n").alias("more"))
    some = sparse.join(counts, "id", "left").where(F.col("m") + F.coalesce("more", F.lit(0)) >= least)
    core = settle(p.join(cells, "cell").where(F.col("m") >= least).select("id", "at", "cell").union(some.select("id", "at", "cell")), trash)
    nodes = settle(core.groupBy("cell").agg(F.min("id").alias("node"), F.count("*").alias("c")), trash)

    pairs = near.where("cell < other").join(nodes, "cell").join(nodes.select(F.col("cell").alias("other"), F.col("node").alias("to"), F.col("c").alias("to_c")), "other")
    pairs = settle(pairs.select("node", "to", F.col("cell").alias("a"), F.col("other").alias("b"), (F.col("c").cast("double") * F.col("to_c")).alias("work")), trash)
    links = _compared(core.withColumn("part", F.col("cell")), pairs.where(F.col("work") <= DIRECT), top)
    rest, fine, part = pairs.where(F.col("work") > DIRECT).select("node", "to", "a", "b"), side, F.col("cell")
    for _ in range(CUTS):
        if rest.isEmpty():
            break
        parts = core.groupBy(part.alias("part")).agg(F.min("at").alias("at"))
        shown = rest.join(parts.select(F.col("part").alias("a"), F.col("at").alias("x")), "a").join(parts.select(F.col("part").alias("b"), F.col("at").alias("y")), "b")
        found = settle(shown.where(_apart("x", "y") <= top).select("node", "to").distinct(), trash)
        links = links.union(found)
        finer = _cell(F.col("at"), fine / 4)
        child = settle(core.select(part.alias("part"), finer.alias("child")).distinct(), trash)
        rest = rest.join(found, ["node", "to"], "left_anti").join(child.select(F.col("part").alias("a"), F.col("child").alias("x")), "a").join(child.select(F.col("part").alias("b"), F.col("child").alias("y")), "b")
        rest = settle(rest.where(_gap("x", "y", fine / 4) <= near_top).select("node", "to", F.col("x").alias("a"), F.col("y").alias("b")), trash)
        fine, part = fine / 4, finer
    links = links.union(_compared(core.withColumn("part", part), rest, top)).distinct()

    roots = components(links, trash)
    label = core.join(nodes.select("cell", "node"), "cell").join(roots, "node", "left").select("id", "at", "cell", F.coalesce("root", "node").alias("label"))
    label = settle(label, trash)
    edge = asks.join(label.select("id"), "id", "left_anti").join(label.select(F.col("cell").alias("other"), F.col("at").alias("to"), "label"), "other")
    edge = edge.where((F.col("cell") == F.col("other")) | (_apart("at", "to") <= top)).groupBy("at").agg(F.min("label").alias("label"))
    known: list[str] = []
    final = settle(label.select(F.col("at").alias("at_"), "label").union(edge), known)
    remove(spark, trash)
    return placed.join(final, "at_", "left").withColumn("cluster", F.coalesce(F.col("label").cast("string"), F.lit("-1"))).drop("at_", "label")


def _compared(core: DataFrame, pairs: DataFrame, top: float) -> DataFrame:
    """node, to of the pairs of parts that have core points within reach of each other."""
    d = pairs.join(core.select(F.col("part").alias("a"), F.col("at").alias("x")), "a").join(core.select(F.col("part").alias("b"), F.col("at").alias("y")), "b")
    return d.where(_apart("x", "y") <= top).select("node", "to").distinct()
