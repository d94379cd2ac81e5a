"""Odd answers and corrections: each has a defined result and none ends the job."""

import json

from pyspark.sql import functions as F

from poledger.operators import ingest, rules, service
from poledger.refdata import LINE_COLUMNS, ROW_COLUMNS

CALL = "doc_id bigint, call_id string, page_no int, attempt string, content string, reasoning string, request_error string, finish_reason string, ended_at int"


def calls(spark, rows):
    return ingest.parse_answers(spark.createDataFrame([(d, c, p, a, text, None, None, "stop", at) for d, c, p, a, text, at in rows], CALL))


def cells(**given):
    return [given.get(c) for c in ROW_COLUMNS]


def line_rows(spark, pages):
    answers = calls(spark, [(1, f"LI-p{p}", p, "first", json.dumps({"rows": rows}), 0) for p, rows in enumerate(pages, 1)])
    return ingest.decode_rows(answers)


def test_two_spellings_and_repeated_keys(spark):
    found = calls(spark, [
        (1, "H", 1, "first", '{"po_no": "A", "po_number": "B"}', 0), (2, "H", 1, "first", '{"po_no": "A", "po_no": "C"}', 0), (3, "H", 1, "first", '{"po_no": ', 0),
    ])
    assert {r.doc_id: r.ok for r in found.collect()} == {1: True, 2: True, 3: False}
    header, errors = ingest.merge_header(found.filter("ok"))
    assert {r.doc_id: r.po_number for r in header.collect()} == {1: "B", 2: "C"} and errors.count() == 0


def test_rows_of_other_shapes(spark):
    rows, errors = line_rows(spark, [[cells(line_no="1"), ["x"] * len(LINE_COLUMNS), 5, None, "text", {"a": 1}, 1.5, True]])
    assert rows.count() == 1
    assert [r.message.rsplit("got ", 1)[1] for r in errors.orderBy("idx").collect()] == ["15", "int", "NoneType", "str", "dict", "float", "bool"]


def test_leading_fragment_takes_the_next(spark):
    rows, _ = line_rows(spark, [[cells(description="head")], [cells(description="tail"), cells(line_no="2", quantity="1", description="next")]])
    joined = ingest.join_fragments(rows).orderBy("page_no", "idx").collect()
    assert [(r.line_no, r.description) for r in joined] == [(None, "head tail"), ("2", "next")]


def test_whole_numbers_with_fractions(spark):
    full = {c: "1" for c in ROW_COLUMNS if c != "line_delivery_date"}
    rows, _ = line_rows(spark, [[cells(**full | {"line_no": "17"}), cells(**full | {"line_no": "17.0", "uom": None}), cells(**full | {"line_no": "17.5"})]])
    good, bad = ingest.type_rows(ingest.dedupe_rows(rows))
    assert [r.line_no for r in good.collect()] == [17] and [r.message for r in bad.collect()] == ["line_no: invalid value"]


def test_the_latest_of_two_retries_counts(spark):
    found = calls(spark, [(1, "H", 1, "first", "{}", 1), (1, "H", 1, "retry", '{"po_no": "late"}', 3), (1, "H", 1, "retry", '{"po_no": "early"}', 2)])
    assert [r.content for r in ingest.best_answer(found).collect()] == ['{"po_no": "late"}']


def test_two_corrections_of_a_field(spark):
    from poledger.refdata import HEADER_FIELDS, header_sql_type

    header = spark.range(1).select(F.lit(1).alias("doc_id"), *[F.lit(None).cast(header_sql_type(f)).alias(f) for f in HEADER_FIELDS])
    fixes = spark.createDataFrame([(1, "buyer_name", "New", 2), (1, "buyer_name", "Old", 1)], "doc_id int, field string, value string, at int")
    assert service.apply_corrections(header, fixes).first()["buyer_name"] == "New"


def test_huge_line_numbers(spark):
    line = spark.range(1).select(F.lit(2_000_000_000).alias("line_no"), F.lit("LI-p1").alias("call_id"), F.lit("73A8").alias("hsn_sac"), *[
        F.lit(1).cast("decimal(15,2)").alias(c) for c in ("quantity", "unit_rate", "discount_pct", "taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "line_total")
    ], F.lit("intra").alias("supply_type"), F.lit(None).cast("date").alias("line_delivery_date"), F.lit(None).cast("date").alias("po_date"))
    problems = line.select(F.array_compact(F.array(*rules._line_problems())).alias("p")).first()["p"]
    assert {(p["rule"], p["ord"]) for p in problems} >= {("line_arithmetic", 4_000_000_001), ("formats", 4_000_000_000)}
