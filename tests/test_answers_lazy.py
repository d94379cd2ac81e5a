"""Line answers and pages are derived without whole headers."""

from poledger.catalog import load
from poledger.sources import bridge

SF = "/root/testdata/sf0.001"


def written(monkeypatch, spark, name):
    monkeypatch.setattr(bridge, "_PATHS", {})
    assert load()[name].run(spark, SF).count() > 0
    return {table for _, _, table in bridge._PATHS}


def test_rows_of_answers_write_only_parties(spark, monkeypatch):
    assert written(monkeypatch, spark, "type_rows") == {"po_party"}


def test_pages_write_no_headers(spark, monkeypatch):
    assert written(monkeypatch, spark, "hints_gstin") == {"po_party", "po_line", "page_text"}
