"""Comparable forms of field values, by comparison type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poledger.functions.dates import parse_date, squeeze

NUMBER_NOISE = r"(?iU)[,\s₹%]|\b(?:inr|rs)\b\.?"
END_PUNCTUATION = " .,;:"


def as_text(v: Column) -> Column:
    folded = F.lower(F.replace(v, F.lit("ß"), F.lit("ss")))
    return F.rtrim(squeeze(folded), F.lit(END_PUNCTUATION))


def as_identifier(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, r"(?U)\s+", ""))


def as_number(v: Column) -> Column:
    """Two decimals half-up, as text; text that is no number stays (normalised) text.
    28 digits: what the reference's arithmetic carries."""
    number = F.regexp_replace(v, NUMBER_NOISE, "").try_cast("decimal(28,2)")
    return F.coalesce(number.cast("string"), as_text(v))


def as_date(v: Column) -> Column:
    return F.coalesce(parse_date(v).cast("string"), as_text(v))


def as_email(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"(?U)\A\s+|\s+\z", ""))


def as_phone(v: Column) -> Column:
    digits = F.regexp_replace(v, r"(?U)\D", "")
    return F.when(digits != "", F.right(digits, F.lit(10))).otherwise(as_text(v))


BY_TYPE = {
    "identifier": as_identifier,
    "number": as_number,
    "date": as_date,
    "email": as_email,
    "phone": as_phone,
    "text": as_text,
}


def normalise(ftype: Column, v: Column) -> Column:
    """Comparable form of `v` by the row's type column; null when blank."""
    out = F.lit(None).cast("string")
    for name, fn in BY_TYPE.items():
        out = F.when(ftype == name, fn(v)).otherwise(out)
    return F.when(v.rlike(r"(?U)\S"), F.nullif(out, F.lit("")))


def key_text(v: Column) -> Column:
    """Letters and digits only, upper case: the form PO numbers and grounding compare by."""
    return F.regexp_replace(F.upper(v), "[^A-Z0-9]", "")
