"""Fields the extraction never asks for: supply type, line taxes, total tax, tax summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poledger.functions import gst
from poledger.functions.once import once


def supply_type() -> Column:
    """intra when the vendor's state is the place of supply, inter when not, null if unknown."""
    h = F.col
    vendor = F.when(gst.is_valid_gstin(h("vendor_gstin")), F.substring("vendor_gstin", 1, 2)).otherwise(
        F.when(gst.is_state_code(h("vendor_state_code")), h("vendor_state_code"))
    )
    place = F.coalesce(
        gst.state_of_place(h("place_of_supply")),
        F.when(gst.is_state_code(h("ship_to_state_code")), h("ship_to_state_code")),
        F.when(gst.is_valid_gstin(h("ship_to_gstin")), F.substring("ship_to_gstin", 1, 2)),
    )
    return F.when(vendor == place, "intra").when(vendor != place, "inter")


def with_supply(header: DataFrame) -> DataFrame:
    """Header plus supply_type and the computed total_tax."""
    return with_total_tax(once(header, supply_type=supply_type()))


def with_total_tax(header: DataFrame) -> DataFrame:
    """Header with the computed total_tax, where its three taxes are there."""
    return header.withColumn(
        "total_tax",
        F.coalesce(
            (F.col("cgst_total") + F.col("sgst_total") + F.col("igst_total")).cast("decimal(18,2)"),
            F.col("total_tax"),
        ),
    )


def _share(rate: float, digits: int) -> Column:
    factor = F.lit(rate).cast(f"decimal({digits + 1},{digits})")
    return F.round(F.col("taxable_value") * F.col("gst_rate") * factor, 2).cast("decimal(18,2)")


def with_line_taxes(lines: DataFrame) -> DataFrame:
    """Lines carrying their document's supply_type, with the three tax amounts recomputed."""
    kind = F.col("supply_type")
    half, whole = _share(0.005, 3), _share(0.01, 2)
    nothing = F.lit(None).cast("decimal(18,2)")
    return lines.withColumns({
        "cgst_amount": F.when(kind == "intra", half).when(kind == "inter", nothing).otherwise(F.col("cgst_amount")),
        "sgst_amount": F.when(kind == "intra", half).when(kind == "inter", nothing).otherwise(F.col("sgst_amount")),
        "igst_amount": F.when(kind == "inter", whole).when(kind == "intra", nothing).otherwise(F.col("igst_amount")),
    })


def hsn_summary(lines: DataFrame) -> DataFrame:
    """Taxable value and taxes by document, HSN/SAC code and rate."""
    money = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("decimal(18,2)")
    return lines.groupBy("doc_id", "hsn_sac", "gst_rate").agg(
        money("taxable_value").alias("taxable"), money("cgst_amount").alias("cgst"),
        money("sgst_amount").alias("sgst"), money("igst_amount").alias("igst"),
    )
