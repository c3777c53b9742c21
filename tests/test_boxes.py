"""Points within a tolerance against all pairs, and entropy without a row per pair."""

import numpy as np
import pytest

from pulseloom.operators import boxes, hrv


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("tol", [0.0, 0.1, 3.0, 100.0])
def test_within_against_all_pairs(monkeypatch, width, tol):
    pick = np.random.default_rng(width)
    points = np.round(pick.normal(0, 5, (400, width)), 1)
    points[pick.random(400) < 0.05, width - 1] = np.nan
    weight, at = pick.integers(1, 4, 400), np.concatenate([points[:150], np.round(pick.normal(0, 9, (80, width)), 1)])
    near = (np.abs(points[None] - at[:, None]) <= tol).all(2) @ weight
    assert (boxes.within(points, weight, at, tol) == near).all()
    monkeypatch.setattr(boxes, "DIRECT", 0 if width < 4 else 500)
    assert (boxes.within(points, weight, at, tol) == near).all()
    assert boxes.within(points[:0], weight[:0], at, tol).sum() == 0 and len(boxes.within(points, weight, at[:0], tol)) == 0


def test_entropy_of_a_long_segment_makes_no_row_per_pair(spark):
    """60,000 beats in copies have some 60 million near templates; equal ones are counted, not paired."""
    rows = spark.range(60000).selectExpr("'a' AS subject", "id + 1 AS i", "800 + cast(pmod(xxhash64(id % 500), 400) AS double) AS rr")
    got = hrv.entropy(rows, ("subject",)).first()["sample_entropy"]
    x = np.array([r["rr"] for r in rows.orderBy("i").limit(500).collect()])
    v, n = np.tile(x, 120), 60000
    tol = 0.2 * v.std()

    def phi(m):
        t = np.stack([np.roll(x, -k) for k in range(m)], 1)  # each of the 500 templates, m - 1 of the last copy cut off
        w = np.full(500, 120)
        if m > 1:
            w[-(m - 1) :] -= 1
        c = (np.abs(t[:, None] - t[None]) <= tol).all(2) @ w
        return (w * np.log(c / (n - m + 1))).sum() / w.sum()

    assert got == pytest.approx(phi(2) - phi(3), rel=1e-9)
