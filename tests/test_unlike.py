"""Pairs that are equal as they stand never leave their wide row, and counts stay those of all pairs."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from poledger.operators import scoring
from poledger.refdata import CRITICAL_HEADER_FIELDS, HEADER_FIELDS, HEADER_KIND, OUTCOMES, header_sql_type


def headers(spark, rows):
    kinds = {"text": "string", "date": "date", "money": "decimal(18,2)"}
    schema = "doc_id bigint, " + ", ".join(f"{f} {header_sql_type(f) or kinds[HEADER_KIND[f]]}" for f in HEADER_FIELDS)
    return spark.createDataFrame([(i, *[r.get(f) for f in HEADER_FIELDS]) for i, r in rows], schema)


def frames(spark):
    full = {"po_number": "PO/1", "po_date": datetime.date(2026, 3, 14), "buyer_name": "Straße Ltd", "subtotal": Decimal("10.00"), "payment_terms": "-- ."}
    truth = headers(spark, [(1, full), (2, full), (3, full), (4, {}), (5, full)])
    pred = headers(spark, [
        (1, full), (2, full | {"po_number": "po/1 ", "buyer_name": "STRASSE  ltd ."}),
        (3, full | {"subtotal": Decimal("10.01"), "po_date": None, "vendor_name": "ghost"}), (4, {"buyer_name": " , "}),
    ])
    return truth, pred


def test_only_pairs_to_compare_leave_the_row(spark):
    got = scoring.unlike_header(*frames(spark)).filter("field is not null and doc_id < 4").select("doc_id", "field", "outcome").collect()
    dashes = {(i, "payment_terms", "correct") for i in (1, 2, 3)}
    assert {tuple(r) for r in got} == dashes | {
        (2, "po_number", "correct"), (2, "buyer_name", "correct"), (3, "subtotal", "wrong"), (3, "po_date", "missed"), (3, "vendor_name", "hallucinated"),
    }


def test_counts_are_those_of_all_pairs(spark):
    good = F.col("outcome").isin(*scoring.CORRECT)
    text = F.col("ftype") == "text"
    want = scoring.score_header(*frames(spark)).groupBy("doc_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if(text).alias("text"),
        F.count_if(text & good).alias("text_exact"), F.count_if(F.col("field").isin(*CRITICAL_HEADER_FIELDS) & ~good).alias("critical_bad"),
    )
    names, _ = scoring.scored()
    got = scoring.unlike_header(*frames(spark)).groupBy("doc_id").agg(*[c.alias(n) for n, c in scoring.counts(names, CRITICAL_HEADER_FIELDS).items()])
    rows = lambda df: sorted(tuple(r) for r in df.select(*sorted(want.columns)).collect())
    assert rows(got) == rows(want)


def test_numbers_stay_as_they_are(spark):
    """Whole line numbers are not printed and read again."""
    rows = spark.createDataFrame([(1, 1, 7)], "doc_id bigint, idx int, line_no int")
    plan = scoring.match_by_number(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
