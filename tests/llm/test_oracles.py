"""Queries with SQL against DuckDB, on awkward documents and on the given tables."""

import os

import duckdb
import pytest

from pulseloom.llm import license_scan, queries, sharding
from tests.llm import test_licenses
from tests.test_oracles import close, plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compared(df, con, sql):
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    want = [tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()]
    key = lambda r: tuple((x is None, "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)) for x in r)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True) if not all(map(close, a, b))]
    assert not bad, bad[:3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    compared(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_license_sql_on_whole_texts(spark, tmp_path):
    from tests.llm import test_exact as t

    made = []
    for text in (t.MIT, t.APACHE, t.BSD, t.GPL):
        for lead in ("", "# ", " * ", "dnl "):
            made.append("\n".join(lead + x for x in text.split("\n")))
            made.append("\r\n".join((lead + x).rstrip() for x in text.replace(", ", ",\n").split("\n")))
    made += [None, "", "// SPDX-License-Identifier: MIT OR Apache-2.0\n// Copyright me", "/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) */ x", "SPDX-License-Identifier: LicenseRef-own", "Our license\nis ours; so\nis this licence: it.", "all rights reserved. x; Licensed under the MIT License\nfoo\n\nbar licence"]
    made += [x + "." for x in license_scan.TEXT_SENTENCES] + [x for _, x in test_licenses.MADE]
    spark.createDataFrame([(k, x) for k, x in enumerate(made)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op8_license_scan", "op8_license_lines"):
        compared(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name])


def test_sharding_against_sql(spark, tmp_path):
    """Shards and slots; DuckDB has no crc32."""
    rows = [(k, f"text {k % 700} " + "x" * (k % 97)) for k in range(4000)] + [(None, None)] * 3 + [(None, "no id"), (5000, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for path in (f"{tmp_path}/documents.parquet/*.parquet", f"{SF}/documents.parquet"):
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
        compared(sharding.op2_sharding(spark, path.removesuffix("/*.parquet").removesuffix("/documents.parquet")).select("doc_id", "size", "shard", "slot"), con, sharding.OP2_SQL)
