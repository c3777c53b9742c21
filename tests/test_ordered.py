"""Sliced running sums, numbers and neighbours against the same over one list."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.functions import ordered
from pulseloom.functions.ordered import beside, numbered, running
from pulseloom.operators.timeagg import quantile_plot

ROWS = [(g, float(v) if v is not None else None, k) for k, (g, v) in enumerate([(("a", "b", None)[x % 3], (x * 7919) % 97) for x in range(500)] + [("a", 5)] * 400 + [("b", None)] * 3)]
SCHEMA = "g string, v double, id int"


def ahead(g, v):
    """Rows of the group with a lesser value, nulls first."""
    return sum(1 for a, b, _ in ROWS if a == g and (b is not None and b < v if v is not None and b is not None else v is not None))


@pytest.mark.parametrize("slices", [2, 8, 256])
def test_running_sums_over_slices(spark, slices):
    d = spark.createDataFrame(ROWS, SCHEMA).groupBy("g", "v").agg(F.count("*").alias("c"))
    got = running(d, ["g"], "v", {"before": F.col("c")}, totals=True, slices=slices).collect()
    assert len(got) == len({(g, v) for g, v, _ in ROWS})
    for r in got:
        assert r["before"] == ahead(r["g"], r["v"])
        assert r["total_before"] == sum(g == r["g"] for g, _, _ in ROWS)


def test_numbers_follow_the_whole_order(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(7)
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in ROWS if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: k + 1 for k, r in enumerate(own)}
    assert {r["id"]: r["n"] for r in numbered(d, ["g"], ["v", "id"], "n", 16).collect()} == want
    # Without keys: one order for all rows.
    own = sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert {r["id"]: r["n"] for r in numbered(d, [], ["v", "id"], "n", 16).collect()} == {r[2]: k + 1 for k, r in enumerate(own)}


@pytest.mark.parametrize("step", [1, -1])
def test_neighbours_cross_slices(spark, step):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in ROWS if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for k, r in enumerate(own):
            near = own[k + step] if 0 <= k + step < len(own) else (None, None, None)
            want[r[2]] = near[1:]
    assert {r["id"]: (r["v2"], r["id2"]) for r in beside(d, ["g"], ["v", "id"], {"v2": "v", "id2": "id"}, step, 16).collect()} == want


def test_empty_tables_and_wrong_orders(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert running(none, ["g"], "v", {"n": F.lit(1)}).count() == 0 and beside(none, [], ["v"], {"w": "v"}).count() == 0
    with pytest.raises(TypeError):
        numbered(none, [], "g", "n")
    with pytest.raises(ValueError, match="step"):
        beside(none, [], ["v"], {"w": "v"}, 2)


def test_quantile_plot(spark):
    d = spark.createDataFrame([("a", float(x)) for x in [3] * 1000 + [1, 9]] + [("b", 4.0)], "g string, v double")
    got = sorted(quantile_plot(d, ["g"], "v", 11).where("g = 'a'").collect(), key=lambda r: r["k"])
    assert [r["v"] for r in got] == [1.0] + [3.0] * 9 + [9.0] and [r["k"] for r in got] == list(range(11))
    assert all(x["theoretical"] < y["theoretical"] for x, y in zip(got, got[1:], strict=False))
    (one,) = quantile_plot(d, ["g"], "v", 11).where("g = 'b'").collect()
    assert one["v"] == 4.0 and abs(one["theoretical"]) < 1e-3


def test_frames_across_blocks(spark):
    """Blocks of few rows that also get their neighbours give the same as one window a group."""
    rows = [(["a", "b", None][i % 7 % 3], i * 37 % 501, float(i * i % 83), i) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, t long, x double, row_id long").repartition(5)

    def columns(w):
        f = w.rowsBetween(-7, 4)
        return {"mean": F.avg("x").over(f), "n": F.count("x").over(f), "back": F.lag("x", 7).over(w), "ahead": F.lead("x", 4).over(w)}

    want = df.withColumns(columns(Window.partitionBy("k").orderBy("t")))
    for size in (12, 50, 10_000):
        got = ordered.framed(df, ["k"], "t", columns, 7, 4, rows=size)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    numbered = ordered.numbered(df, ["k"], "t", "at")
    got = ordered.framed(numbered, ["k"], "t", columns, 7, 4, number="at", rows=20).drop("at")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("factors", [[], [0.7], [0.5, -0.3], [0.0, 0.0, 0.0, 0.9], [0.2, 0.1] + [0.0] * 70 + [-0.4]])
@pytest.mark.parametrize("slices", [1, 7, 256])
def test_recursion_over_slices(spark, factors, slices):
    rnd = np.random.default_rng(3)
    rows = [(["a", "b", None][int(i > 500) + int(i > 900)], i, float(x)) for i, x in enumerate(rnd.normal(0, 1, 950))] + [("b", 5000, None)]
    want = {}
    for k in ("a", "b", None):
        out = []
        for key, i, u in rows:
            if key == k:
                out.append((u or 0.0) + sum(f * out[-j] for j, f in enumerate(factors, 1) if j <= len(out)))
                want[i] = out[-1]
    df = spark.createDataFrame(rows, "k string, i long, u double").repartition(4)
    got = ordered.recursion(df, ["k"], "i", "u", "x", factors, slices)
    assert got.columns == ["k", "i", "u", "x"]
    got = {r["i"]: r["x"] for r in got.collect()}
    np.testing.assert_allclose([got[i] for i in sorted(want)], [want[i] for i in sorted(want)], rtol=1e-9, atol=1e-9)


def test_one_long_recursion(spark):
    """A single series of a million steps on many tasks."""
    df = spark.range(1_000_000).select("id", F.sin("id").alias("u"))
    out = ordered.recursion(df, [], "id", "u", "x", [0.7])
    (got,) = out.where("id in (999999)").select("x").collect()
    assert abs(got["x"] - sum(0.7**j * math.sin(999_999 - j) for j in range(200))) < 1e-9 and out.count() == 1_000_000
