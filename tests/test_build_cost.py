"""What Python sends to Spark to build an expression stays small; results stay."""

from pyspark.sql import functions as F

from poledger.functions import dates, gst, words
from poledger.operators import ingest
from poledger.refdata import HEADER_FIELDS, HEADER_KIND


def test_only_dates_are_built_as_dates(spark, monkeypatch):
    built = []
    monkeypatch.setattr(ingest, "parse_date", lambda v: built.append(1) or dates.parse_date(v))
    ingest.typed_header(spark.createDataFrame([], "doc_id long, call_id string, answer string"))
    assert len(built) == sum(HEADER_KIND[f] == "date" for f in HEADER_FIELDS)


def test_fixed_texts_are_one_expression(spark, monkeypatch):
    sent = []
    real = F.lit
    monkeypatch.setattr(F, "lit", lambda v: sent.append(v) or real(v))
    gst.state_of_place(F.col("v")), gst.is_state_code(F.col("v")), gst.is_valid_gstin(F.col("v")), words.parse_words(F.col("v"))
    assert len(sent) < 50  # one for each state, number word and code before


def test_digits_count_double_at_even_places():
    assert sorted(gst.DOUBLED) == sorted(gst.ALPHANUMERIC)
    for v, c in enumerate(gst.ALPHANUMERIC):
        assert gst.DOUBLED.index(c) == (2 * v if v < 18 else 2 * v - 35)


def test_rule_expressions_are_built_once(spark):
    from poledger.operators import rules

    for make in (*rules.HEADER_RULES.values(), rules._line_problems):
        assert make() is make()
