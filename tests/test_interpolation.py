"""Linear filling of null heart rates."""

from pulseloom.operators import clean


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_interpolation_looks_back_only(spark):
    d = spark.createDataFrame([("s", 1, float(t), t, hr) for t, hr in enumerate([None, 60.0, None, None, 90.0, None])] + [("s", 2, 0.0, 0, None)], "subject string, sol int, t double, seq int, hr double")
    out = clean.interpolate(d)
    assert "unboundedfollowing" not in plan(out).lower()
    assert {(r["sol"], r["seq"]): r["filled"] for r in out.collect()} == {(1, 0): 60.0, (1, 1): 60.0, (1, 2): 70.0, (1, 3): 80.0, (1, 4): 90.0, (1, 5): 90.0, (2, 0): None}
