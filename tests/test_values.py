"""Value tables: each expression against known answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from poledger.functions import dates, fuzzy, gst, normal, printing, words


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_gstin(spark):
    values = ["27AAPFU0939F1ZV", "27AAPFU0939F1ZW", "99AAPFU0939F1ZV", "27aapfu0939f1zv", "", None]
    assert run(spark, gst.is_valid_gstin, values) == [True, False, False, False, False, False]


def test_any_single_change_breaks_a_gstin(spark):
    good = "27AAPFU0939F1ZV"
    broken = [good[:i] + ("1" if good[i] != "1" else "2") + good[i + 1 :] for i in range(15)]
    assert not any(run(spark, gst.is_valid_gstin, broken))


def test_dates(spark):
    table = {
        "14/03/2026": "2026-03-14", "03/14/2026": None, "2026-3-4": "2026-03-04", "14th Mar, 2026": "2026-03-14",
        "14-Mar-26": "2026-03-14", "March 14, 2026": "2026-03-14", "31/02/2026": None, "14 Mayor 2026": None,
        "0000-01-01": None, "sept 3 2020": "2020-09-03", "3.4.21": "2021-04-03", "": None, "29/02/2024": "2024-02-29",
    }
    assert run(spark, lambda c: dates.parse_date(c).cast("string"), list(table)) == list(table.values())


def test_places(spark):
    table = {"27-Maharashtra": "27", "Maharashtra (27)": "27", " goa ": "30", "Lot 99, 05": "05", "Nowhere": None}
    assert run(spark, gst.state_of_place, list(table)) == list(table.values())


def test_words(spark):
    table = {
        "Rupees Two Lakh Forty Five Thousand Three Hundred Twelve and Fifty Paise Only": Decimal("245312.50"),
        "One Lakh Crore": Decimal("1000000000000.00"), "one hundred and five and paise five": Decimal("105.05"),
        "fifty paise": Decimal("0.50"), "nothing like it": None, "Rupees Only": None,
    }
    assert run(spark, lambda c: words.parse_words(c)["amount"], list(table)) == list(table.values())


def test_words_round_trip(spark):
    amounts = [str(Decimal(n) / 100) for n in (5, 100, 99999, 1234567890, 10**14 + 705, 2_000_000_000)]
    back = run(spark, lambda c: words.parse_words(words.amount_to_words(c.cast("decimal(18,2)")))["amount"], amounts)
    assert back == [Decimal(a).quantize(Decimal("0.01")) for a in amounts]


@pytest.mark.parametrize(
    "kind,value,want",
    [("number", "₹ 1,23,456.505", "123456.51"), ("number", "abc D.", "abc d"), ("text", "Straße ,", "strasse"),
     ("phone", "+91 96290 10123", "9629010123"), ("date", "1 jan 2020", "2020-01-01"), ("identifier", "a b", "AB"),
     ("text", "   ", None), ("email", " A@B.co ", "a@b.co")],
)
def test_normalise(spark, kind, value, want):
    assert run(spark, lambda c: normal.normalise(F.lit(kind), c), [value]) == [want]


def test_printing(spark):
    assert run(spark, lambda c: printing.money(c.cast("decimal(18,2)")), ["1234567.8", "-100", "0"]) == [
        "12,34,567.80", "-100.00", "0.00",
    ]


def test_token_set():
    assert fuzzy.token_set("a b", "b a c") == 100
    assert fuzzy.token_set("hello", "hallo") == 80
    assert fuzzy.token_set("", "a") == 0
