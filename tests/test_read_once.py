"""Answers of a round are read once, however many tables come out of them."""

import json

from poledger.operators import ingest

ROWS = {"rows": [["1", "A-1"] + [None] * 10, [1, 2, 3], "oops"]}


def test_header_and_its_errors_share_the_typed_values(spark):
    answer = json.dumps({"po_no": "P7", "po_dt": "31/02/2026", "subtotal": "5", "foo": 1})
    typed = ingest.typed_header(spark.createDataFrame([(1, "H", answer)], "doc_id long, call_id string, answer string"))
    header, errors = ingest.header_parts(typed)
    row = header.first()
    assert (row["po_number"], row["po_date"], float(row["subtotal"]), row["igst_total"]) == ("P7", None, 5.0, 0)
    assert sorted(map(tuple, errors.collect())) == [(1, "foo", "unknown field"), (1, "po_date", "not a date value")]


def test_rows_and_their_errors_share_the_split_rows(spark):
    answers = spark.createDataFrame([(1, "LI-p1", 1, json.dumps(ROWS))], "doc_id long, call_id string, page_no int, answer string")
    split = ingest.split_rows(answers)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2
    rows, errors = ingest.row_parts(split)
    assert [(r["idx"], r["line_no"], r["item_code"]) for r in rows.collect()] == [(0, "1", "A-1")]
    assert sorted((r["idx"], r["message"]) for r in errors.collect()) == [(1, "expected 12 cells, got 3"), (2, "expected 12 cells, got str")]
    # the filter of whole rows does not read them again
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2
