"""Value-cleaning jobs: a table in, a typed column or a verdict out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.functions import gst, words
from poledger.functions.dates import parse_date
from poledger.functions.normal import normalise
from poledger.refdata import GSTIN_STATE_CODES, PARTIES


def party_values(header: DataFrame, suffix: str) -> DataFrame:
    """(doc_id, party, value) of one party attribute, in a single pass over the header."""
    rows = [
        F.struct(F.lit(p).alias("party"), F.col(f"{p}_{suffix}").alias("value"))
        for p in PARTIES
        if f"{p}_{suffix}" in header.columns
    ]
    return header.select("doc_id", F.inline(F.array(*rows))).filter("value is not null")


def audit_gstin(values: DataFrame) -> DataFrame:
    """Adds `problem`: format, state code, check character, or null when valid."""
    v = F.col("value")
    return values.withColumn(
        "problem",
        F.when(~v.rlike(gst.GSTIN_SHAPE), "format")
        .when(~F.substring(v, 1, 2).isin(*GSTIN_STATE_CODES), "state code")
        .when(gst.gstin_check_char(v) != F.substring(v, 15, 1), "check character"),
    )


def audit_pan(values: DataFrame, gstins: DataFrame) -> DataFrame:
    """PAN validity, and agreement with the PAN inside the party's valid GSTIN."""
    g = gstins.select("doc_id", "party", F.col("value").alias("gstin"))
    v = F.col("value")
    return values.join(g, ["doc_id", "party"], "left").select(
        "doc_id", "party", "value", gst.is_valid_pan(v).alias("valid"),
        F.when(gst.is_valid_gstin(F.col("gstin")), v == gst.pan_of(F.col("gstin"))).alias("matches"),
    )


def parse_dates(texts: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a `parsed` date, refused rows)."""
    parsed = texts.withColumn("parsed", parse_date(F.col(column)))
    return parsed.filter("parsed is not null"), parsed.filter("parsed is null").drop("parsed")


def place_to_state(header: DataFrame) -> DataFrame:
    return header.select(
        "doc_id",
        gst.state_of_place(F.col("place_of_supply")).alias("place_state"),
        gst.state_of_address(F.col("buyer_address")).alias("buyer_state"),
        gst.state_of_address(F.col("vendor_address")).alias("vendor_state"),
    )


def words_to_amount(header: DataFrame) -> DataFrame:
    return (
        header.filter("amount_in_words is not null")
        .select("doc_id", words.parse_words(F.col("amount_in_words")).alias("p"))
        .select("doc_id", "p.amount", "p.problem")
    )


def normalise_long(values: DataFrame) -> DataFrame:
    """(.., ftype, value) -> adds `norm`."""
    return values.withColumn("norm", normalise(F.col("ftype"), F.col("value")))
