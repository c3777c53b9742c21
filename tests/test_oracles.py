"""Every query with an oracle against DuckDB on the same Parquet files."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from pulseloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, datetime | date):
        return x.isoformat()
    return x


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    relation = duck.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    want = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall()]
    order = lambda r: tuple((x is None, "" if x is None else str(round(x, 3) + 0.0 if isinstance(x, float) else x)) for x in r)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True) if not all(map(close, a, b))]
    assert not bad, bad[:3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql(name, spark):
    """Rows, values in every column, shares between 0 and 1, intervals the right way round."""
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert not [c for c in df.columns if all(r[c] is None for r in rows)]
    for r in rows:
        assert all(0 <= r[c] <= 1 for c in df.columns if (c.startswith("p_") or c.endswith("_p") or c == "p_value") and r[c] is not None and not math.isnan(r[c]))
        for c in df.columns:
            high = c.replace("low", "high")
            if high != c and high in df.columns and r[c] is not None and r[high] is not None:
                assert r[c] <= r[high]
