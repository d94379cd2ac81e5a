"""The rule on formats reads few columns: it writes no whole table, and the base of the headers is no table of its own."""

from poledger.catalog import load
from poledger.sources import bridge

SF = "/root/testdata/sf0.001"


def test_formats_writes_only_parties(spark, monkeypatch):
    monkeypatch.setattr(bridge, "_PATHS", {})
    assert load()["check_formats"].run(spark, SF).count() > 0
    assert {table for _, _, table in bridge._PATHS} == {"po_party"}


def test_header_needs_two_tables(spark, monkeypatch):
    monkeypatch.setattr(bridge, "_PATHS", {})
    bridge.table(spark, SF, "po_header")
    assert {table for _, _, table in bridge._PATHS} == {"po_party", "po_line", "po_header"}
