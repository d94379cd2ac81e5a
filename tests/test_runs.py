"""Runs appear at once, and document files come back as they were written."""

import json

import pytest

from poledger.plans.staging import place
from poledger.sources import runs


def tables(spark, *statuses):
    rows = [(f"d{i}", s) for i, s in enumerate(statuses)]
    return {"records": spark.createDataFrame(rows, "doc_id string, status string"), "config": runs.config_row(spark, pipeline="p", dpi=120)}


def statuses(spark, root, run):
    return sorted(r.status for r in runs.read_run(spark, root, run, "records").collect())


def test_a_run_is_seen_whole_or_not_at_all(spark):
    root = place(spark, "store")
    runs.stage_run(tables(spark, "half"), root, "a")  # a writer that died before its commit
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, root, "a", "records")
    with pytest.raises(FileNotFoundError):  # no run yet, so nothing to overwrite
        runs.write_run(tables(spark, "x"), root, "a", overwrite=True)
    runs.write_run(tables(spark, "one", "two"), root, "a")
    runs.write_run(tables(spark, "other"), root, "b")
    assert statuses(spark, root, "a") == ["one", "two"] and statuses(spark, root, "b") == ["other"]
    with pytest.raises(FileExistsError):
        runs.write_run(tables(spark, "x"), root, "a")
    runs.stage_run(tables(spark, "half again"), root, "a")
    assert statuses(spark, root, "a") == ["one", "two"]
    runs.write_run(tables(spark, "new"), root, "a", overwrite=True)
    assert statuses(spark, root, "a") == ["new"]
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, root, "a", "outputs")
    assert runs.read_run(spark, root, "a", "config").first().dpi == 120
    assert {(r.run_id, r.number) for r in runs.commits(spark, root).collect()} == {("a", 2), ("b", 1)}


def test_unknown_settings_are_refused(spark):
    with pytest.raises(ValueError, match="colour"):
        runs.config_row(spark, colour="red")


def test_one_file_for_each_document(spark, tmp_path):
    for name, text in {
        "truth/P1.json": {"po": {"po_number": "7", "grand_total": 12.5, "line_items": [{"line_no": 1, "quantity": 2}, {"line_no": 2}]}, "meta": {"id": "other"}},
        "out/P1.json": {"doc_id": "P1", "status": "completed", "po": {"po_number": "7"}}, "out/P2.json": {"doc_id": "P2", "status": "failed", "error": "late"},
        "raw/P1.json": {"calls": [{"call_id": "H", "attempt": "first", "content": "{}"}, {"call_id": "LI", "attempt": "retry"}]},
        "masters/parties.json": [{"gstin": "29A", "name": "n", "state_code": "29", "role": "buyer"}],
        "masters/items.json": [{"issuer_gstin": "29AAAAA0000A1Z5", "item_code": "c"}],
        "masters/processed_po_numbers.json": {"29AAAAA0000A1Z5": {"issuer_id": "i", "po_numbers": ["po/1", "PO-1", "2"]}},
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(text))
    header, lines = runs.read_truth(spark, f"{tmp_path}/truth")
    assert [(r.id, r.po_number, float(r.grand_total)) for r in header.collect()] == [("P1", "7", 12.5)]
    assert sorted((r.id, r.line_no) for r in lines.collect()) == [("P1", 1), ("P1", 2)]
    assert sorted((r.doc_id, r.status, r.po and r.po.po_number) for r in runs.read_outputs(spark, f"{tmp_path}/out").collect()) == [("P1", "completed", "7"), ("P2", "failed", None)]
    assert sorted((r.doc_id, r.call_id, r.attempt) for r in runs.read_raw_calls(spark, f"{tmp_path}/raw").collect()) == [("P1", "H", "first"), ("P1", "LI", "retry")]
    parties, items, processed = runs.read_masters(spark, f"{tmp_path}/masters")
    assert parties.count() == 1
    codes, numbers = runs.index_masters(items, processed)
    assert [tuple(r) for r in codes.collect()] == [("AAAAA0000A", "c")]
    assert sorted(tuple(r) for r in numbers.collect()) == [("AAAAA0000A", "2"), ("AAAAA0000A", "PO1")]


def test_the_error_file_names_run_documents(spark):
    rows = [("PO_1_S", "S", 1, "po_number", "wrong", None, "a", "b"), ("PO_1", "N", 1, "po_number", "wrong", 3, None, "b,\"c\"\nd")]
    errors = spark.createDataFrame(rows, "run_doc string, variant string, doc_id long, field string, outcome string, row int, truth string, pred string")
    path = place(spark, "errors")
    got = sorted(tuple(r) for r in runs.error_file(errors).collect())
    assert got == [("PO_1", "N", "po_number", "wrong", "3", "", "b,\"c\"\nd", ""), ("PO_1_S", "S", "po_number", "wrong", "", "a", "b", "")]
    runs.write_errors(errors.filter("row is null"), path)
    assert [tuple(r) for r in runs.read_errors(spark, path).collect()] == [got[1]]
