"""Rank tests of counts whose cubes pass 64 bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import stats


@pytest.fixture(scope="module")
def long(spark):
    """2.4 million rows of two values: 0 (2.2 million, mostly of a) and 1."""
    d = spark.range(2_400_000).select(F.lit("m").alias("metric"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("grp"), ((F.col("id") % 12 == 0).cast("double")).alias("value"))
    return d


def expected(na0, na1, nb0, nb1):
    n0, n1 = na0 + nb0, na1 + nb1
    n = n0 + n1
    r0, r1 = (n0 + 1) / 2, n0 + (n1 + 1) / 2
    ra, rb, na, nb = na0 * r0 + na1 * r1, nb0 * r0 + nb1 * r1, na0 + na1, nb0 + nb1
    ties = n0**3 - n0 + n1**3 - n1
    h = (12 / (n * (n + 1)) * (ra**2 / na + rb**2 / nb) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    z = (ra - na * (na + 1) / 2 - na * nb / 2) / np.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
    dunn = (ra / na - rb / nb) / np.sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / na + 1 / nb))
    return h, z, dunn


COUNTS = (1_600_000, 0, 600_000, 200_000)


def test_kruskal_of_over_two_million_rows(long):
    row = stats.kruskal(long).first()
    assert row["h"] == pytest.approx(expected(*COUNTS)[0], rel=1e-9)


def test_dunn_of_over_two_million_ties(long):
    assert stats.dunn(long).first()["z"] == pytest.approx(expected(*COUNTS)[2], rel=1e-9)


def test_mann_whitney_of_over_two_million_ties(long):
    assert stats.mann_whitney(long, "a", "b").first()["z"] == pytest.approx(expected(*COUNTS)[1], rel=1e-9)


def test_wilcoxon_of_over_two_million_ties(spark):
    d = spark.range(2_400_000).select(F.lit("m").alias("metric"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("x"), F.lit(0.0).alias("y"))
    n = 2_400_000
    sd = np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48)
    row = stats.wilcoxon(d).first()
    assert row["z"] == pytest.approx((1_600_000 * (n + 1) / 2 - n * (n + 1) / 4) / sd, rel=1e-9)
