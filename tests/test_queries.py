"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from poledger.catalog import load
from poledger.sources import bridge

SF = "/root/testdata/sf0.001"
QUERIES = load()
FAST = ["audit_gstin", "parse_dates", "skipped_pages", "check_line_arithmetic", "match_line_no", "dedupe_rows",
        "job_state", "metrics_window", "build_masters", "expand_variants", "records_scan"]
#: All queries with SQL where ALL_QUERIES is set (about ten minutes), else some of each kind.
NAMES = [n for n, q in QUERIES.items() if q.sql] if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for b in bridge.BASE_TABLES:
        con.sql(f"CREATE VIEW {b} AS SELECT * FROM '{SF}/{b}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name].run(spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = duck.sql(QUERIES[name].sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_oracle_run_scores_full_marks(spark):
    r = QUERIES["oracle_run_score"].run(spark, SF).collect()[0]
    assert (r["field_accuracy"], r["critical_doc_accuracy"], r["row_recall"]) == (1.0, 1.0, 1.0)
