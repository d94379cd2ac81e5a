"""Queries that read few columns of a derived table once do not write whole tables first."""

import pytest

from poledger.catalog import load
from poledger.sources import bridge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["total_tax", "master_items"])
def test_only_parties_are_written(spark, monkeypatch, name):
    monkeypatch.setattr(bridge, "_PATHS", {})
    assert load()[name].run(spark, SF).count() > 0
    assert {table for _, _, table in bridge._PATHS} == {"po_party"}


def test_total_tax_numbers_no_rows(spark, monkeypatch):
    monkeypatch.setattr(bridge, "_PATHS", {})
    plan = load()["total_tax"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
