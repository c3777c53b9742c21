"""Running sums, numbers and neighbouring rows of a whole group without one task for the group.

Rows are cut into slices by quantiles of their order column over all groups, so a slice of a group holds about 1 / SLICES of all rows
at most, whatever the groups' sizes, unless more rows share one value of that column. Windows work inside a slice; what crosses slices
is a table of a row per group and slice. Equal values of the order column share a slice; nulls sort first and are in slice 0; a null
key is a group like any other.

framed() cuts groups into blocks of rows that also get the rows just before and after them, for windows of a bounded frame.
recursion() composes a linear recursion's slices as affine maps of its last values, so a single series runs on all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICES, FRAME_ROWS = 256, 20_000

PLACE = "place_"


def _sliced(df: DataFrame, keys: Sequence[str], order: str, slices: int) -> DataFrame:
    """df with the struct place_ of its keys and its slice; the cuts are one row of slices - 1 numbers."""
    if df.schema[order].dataType.typeName() == "string":
        raise TypeError(f"{order} has no quantiles: order by a number, date or timestamp first")
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(k / slices) for k in range(1, slices)]), F.lit(100 * slices)).alias("cuts_"))
    below = F.coalesce(F.size(F.filter("cuts_", lambda c: c < F.col(order))), F.lit(0))
    return df.join(F.broadcast(cuts)).withColumn(PLACE, F.struct(*keys, below.alias("slice_"))).drop("cuts_")


def _over_slices(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(f"{PLACE}.{k}") for k in keys])


def running(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: dict[str, Column], totals: bool = False, slices: int = SLICES) -> DataFrame:
    """df with a column for each of `sums`: its sum over the group's rows that come earlier, 0 for the first; and total_<name> over the group.

    The first column of `order` is a number, date or timestamp. Sums are of whole numbers where results have to be exact.
    """
    order = [order] if isinstance(order, str) else list(order)
    d = _sliced(df, keys, order[0], slices).withColumns({f"own_{n}": c for n, c in sums.items()})
    per = d.groupBy(PLACE).agg(*[F.sum(f"own_{n}").alias(f"all_{n}") for n in sums])
    group = _over_slices(keys)
    ahead = group.orderBy(f"{PLACE}.slice_").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(PLACE, *[F.coalesce(F.sum(f"all_{n}").over(ahead), F.lit(0)).alias(f"ahead_{n}") for n in sums], *[F.sum(f"all_{n}").over(group).alias(f"total_{n}") for n in sums if totals])
    inside = Window.partitionBy(PLACE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({n: F.coalesce(F.sum(f"own_{n}").over(inside), F.lit(0)) for n in sums}).join(per, PLACE)
    return d.withColumns({n: F.col(n) + F.col(f"ahead_{n}") for n in sums}).drop(PLACE, *[f"{p}_{n}" for p in ("own", "ahead") for n in sums])


def numbered(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str, slices: int = SLICES) -> DataFrame:
    """df with the row's number within its group, from 1."""
    return running(df, keys, order, {name: F.lit(1)}, slices=slices).withColumn(name, F.col(name) + 1)


def beside(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: dict[str, str], step: int = 1, slices: int = SLICES) -> DataFrame:
    """df with the next (step 1) or previous (step -1) row's columns: names maps each new column to the column that it is taken from.

    The first column of `order` is a number, date or timestamp; `order` and the columns taken tell the rows of a slice's edge apart.
    """
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    taken = list(names.values())
    edge, turn = (F.min, F.lead) if step == 1 else (F.max, F.lag)
    d = _sliced(df, keys, order[0], slices)
    per = d.groupBy(PLACE).agg(edge(F.struct(*order, *[F.col(c).alias(f"taken_{k}") for k, c in enumerate(taken)])).alias("edge_"))
    per = per.select(PLACE, turn("edge_").over(_over_slices(keys).orderBy(f"{PLACE}.slice_")).alias("edge_"))
    inside = Window.partitionBy(PLACE).orderBy(*order)
    last = turn(F.lit(1)).over(inside).isNull()
    d = d.withColumns({**{f"near_{k}": turn(c).over(inside) for k, c in enumerate(taken)}, "last_": last}).join(per, PLACE)
    got = {n: F.when(F.col("last_"), F.col(f"edge_.taken_{k}")).otherwise(F.col(f"near_{k}")) for k, n in enumerate(names)}
    return d.withColumns(got).drop(PLACE, "edge_", "last_", *[f"near_{k}" for k in range(len(taken))])


def framed(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], columns: Callable[[WindowSpec], dict[str, Column]], before: int, after: int, number: str | None = None, rows: int = FRAME_ROWS) -> DataFrame:
    """df with columns(w), window columns that look at most `before` rows back and `after` rows ahead.

    w is ordered and holds a block of `rows` rows of a group and the rows that these look at, so a group is as many tasks as it has
    blocks. `number`, where given, is a column of the rows' numbers within their group, without gaps; else rows are numbered first.
    """
    at = number or "row_"
    d = df if number else numbered(df, keys, order, at)
    size = max(rows, before + after + 1)
    block = lambda shift: F.floor((F.col(at) + shift) / size)
    d = d.withColumn("block_", F.explode(F.sequence(block(-after), block(before))))
    d = d.withColumns(columns(Window.partitionBy(*keys, "block_").orderBy(at))).where(F.col("block_") == block(0))
    return d.drop("block_") if number else d.drop("block_", at)


def _recursed(drive: np.ndarray, factors: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x_t = drive_t + factors[0] x_t-1 + ..., where start holds x_-1, x_-2, ...; by blocks of steps at once."""
    r = len(factors)
    size = max(64, r)
    back = np.zeros((r + size, r + 1))  # of r steps before and `size` after: answers to each start value and, last, to a unit drive
    back[np.arange(r)[::-1], np.arange(r)] = 1
    for t in range(r, r + size):
        back[t] = factors @ back[t - r : t][::-1] + (np.arange(r + 1) == r) * (t == r)
    from_start, unit = back[r:, :r], back[r:, r]
    steps = np.arange(size)
    answer = np.where(steps[:, None] >= steps, unit[np.maximum(0, steps[:, None] - steps)], 0)
    full = np.zeros(-(-len(drive) // size) * size)
    full[: len(drive)] = drive
    out = full.reshape(-1, size) @ answer.T
    state = start
    for k in range(len(out)):
        out[k] += from_start @ state
        state = out[k][::-1][:r]
    return out.ravel()[: len(drive)]


def recursion(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], drive: str, name: str, factors: Sequence[float] | str, slices: int = SLICES) -> DataFrame:
    """df with the column name: x_t = drive_t + factors[0] x_t-1 + factors[1] x_t-2 + ... along each group; x is 0 before the first row.

    factors are numbers, or an array column that is the same in all rows of a group. A null drive counts as 0. Every slice is run from
    zeros; its last values, as an affine map of the ones before it, are composed over a group's slices, a row each; then every slice
    runs from its own start.
    """
    order = [order] if isinstance(order, str) else list(order)
    own = f"{name}_factors_"
    listed = F.col(factors) if isinstance(factors, str) else F.array(*[F.lit(float(f)) for f in factors]).cast("array<double>")
    d = _sliced(df, keys, order[0], slices).withColumns({"slice_": F.col(f"{PLACE}.slice_"), own: listed}).drop(PLACE)
    place = [*keys, "slice_"]
    schema = {f.name: f for f in d.schema.fields}
    kind = lambda names, more: ", ".join([*[f"`{k}` {schema[k].dataType.simpleString()}" for k in names], more])

    def parts(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.sort_by([(c, "ascending") for c in order])
        return t, np.nan_to_num(t[drive].cast(pa.float64()).to_numpy()), np.array(t[own][0].as_py() or [], float)

    def local(t: pa.Table) -> pa.Table:
        t, u, f = parts(t)
        x = np.concatenate([np.zeros(len(f)), _recursed(u, f, np.zeros(len(f)))])
        end = x[::-1][: len(f)]
        return t.slice(0, 1).select(place).append_column("n", pa.array([len(u)], pa.int64())).append_column(own, pa.array([f], pa.list_(pa.float64()))).append_column("end", pa.array([end], pa.list_(pa.float64())))

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("slice_")
        f = np.array(t[own][0].as_py(), float)
        step = np.vstack([f, np.eye(len(f))[:-1]]) if len(f) else np.zeros((0, 0))
        state, starts = np.zeros(len(f)), []
        for n, end in zip(t["n"].to_pylist(), t["end"].to_pylist(), strict=True):
            starts.append(state)
            state = np.linalg.matrix_power(step, n) @ state + np.array(end, float)
        return t.select(place).append_column("start_", pa.array(starts, pa.list_(pa.float64())))

    def final(t: pa.Table, start: pa.Table) -> pa.Table:
        t, u, f = parts(t)
        return t.drop_columns([own]).append_column(name, pa.array(_recursed(u, f, np.array(start["start_"][0].as_py(), float))))

    ends = d.select(*place, *order, drive, own).groupBy(*place).applyInArrow(local, kind(place, f"n long, {own} array<double>, end array<double>"))
    starts = ends.groupBy(*keys).applyInArrow(compose, kind(place, "start_ array<double>"))
    rest = [c for c in d.columns if c != own]
    return d.groupBy(*place).cogroup(starts.groupBy(*place)).applyInArrow(final, kind(rest, f"`{name}` double")).drop("slice_")
