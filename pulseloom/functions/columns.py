"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT = ("subject", "sol")


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """top / bottom, or otherwise where bottom isn't over 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def over_segment(keys: tuple[str, ...] = SEGMENT, *order: str) -> WindowSpec:
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, as the oracles round theirs."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def median(x) -> Column:
    return F.percentile(x, F.lit(0.5))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows that have both; null where one of them doesn't vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
