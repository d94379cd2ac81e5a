"""Queries that read the answers once write no copy of them, nor of the tables they are made of."""

import pytest

from poledger.catalog import load
from poledger.sources import bridge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["merge_header_errors", "merge_header", "reasoning_tokens"])
def test_no_answers_are_written(spark, monkeypatch, name):
    monkeypatch.setattr(bridge, "_PATHS", {})
    assert load()[name].run(spark, SF).count() > 0
    assert {n for _, _, n in bridge._PATHS} == {"po_party"}
