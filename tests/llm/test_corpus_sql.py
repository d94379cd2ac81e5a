"""Operator queries against their SQL on the smallest tables."""

import duckdb
import pytest

from poledger.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q[1]])
def test_query_matches_sql(spark, name):
    run, sql = QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = run(spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
