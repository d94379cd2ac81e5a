"""Printed dates, read day-first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poledger.functions.constants import number_map
from poledger.refdata import MONTH_SPELLINGS, MONTHS

_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
ISO = r"\A(\d{4})-(\d{1,2})-(\d{1,2})\z"
DAY_FIRST = r"\A(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\z"
DAY_NAME = rf"\A{_DAY}[ /.-]*([a-z]+)\.?,?[ /.-]*(\d{{4}}|\d{{2}})\z"
NAME_DAY = rf"\A([a-z]+)\.? {_DAY},? (\d{{4}})\z"


def squeeze(text: Column) -> Column:
    """Blanks trimmed and collapsed (any Unicode blank)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def month_number(name: Column) -> Column:
    """1..12 of a known spelling, else null."""
    starts = [m[:3] for m in MONTHS]
    return F.try_element_at(number_map({s: starts.index(s[:3]) + 1 for s in MONTH_SPELLINGS}, "INT"), name)


def parse_date(value: Column) -> Column:
    """The date a printed text stands for; null for anything unknown or impossible.

    Every shape becomes year-month-day text first, so one guarded cast rejects 31 February and
    month-first dates alike. Two-digit years are 20yy.
    """
    t = F.lower(squeeze(value))

    def ymd(pattern: str, y: int, d: int, month: Column) -> Column:
        year = F.regexp_extract(t, pattern, y)
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        return F.concat_ws("-", year, month.cast("string"), F.regexp_extract(t, pattern, d))

    def named(pattern: str, m: int) -> Column:
        return F.coalesce(month_number(F.regexp_extract(t, pattern, m)), F.lit(0))

    text = (
        F.when(t.rlike(ISO), t)
        .when(t.rlike(DAY_FIRST), ymd(DAY_FIRST, 3, 1, F.regexp_extract(t, DAY_FIRST, 2)))
        .when(t.rlike(DAY_NAME), ymd(DAY_NAME, 3, 1, named(DAY_NAME, 2)))
        .when(t.rlike(NAME_DAY), ymd(NAME_DAY, 3, 2, named(NAME_DAY, 1)))
    )
    return F.when(~text.startswith("0000"), text.try_cast("date"))
