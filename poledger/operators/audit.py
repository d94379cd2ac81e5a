"""Exact consistency of truth tables: no tolerance, one row per violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.functions import gst
from poledger.functions.words import amount_to_words
from poledger.refdata import HEADER_FIELDS, PARTIES


def _rows(df: DataFrame, cases: dict) -> DataFrame:
    named = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cases.items()]
    return df.select("doc_id", F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("violation"))


def consistency(header: DataFrame, lines: DataFrame, words: bool = True) -> DataFrame:
    """(doc_id, violation) of parties, places, dates, numbering, lines and totals."""
    c = F.col
    place = gst.state_of_place(c("place_of_supply"))
    h = header.withColumn("inter", ~(F.substring("vendor_gstin", 1, 2).eqNullSafe(place)))
    zero = F.lit(0).cast("decimal(18,2)")
    z = lambda n: F.coalesce(c(n), zero)
    sums = lines.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("line_no").alias("low"), F.max("line_no").alias("high"),
        *[F.sum(F.coalesce(c(x), zero)).cast("decimal(18,2)").alias(f"s_{x}")
          for x in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount")],
    )
    cases = {}
    for p in PARTIES:
        g = c(f"{p}_gstin")
        ok, code = gst.is_valid_gstin(g), F.substring(g, 1, 2)
        cases[f"{p}: invalid GSTIN"] = g.isNotNull() & ~ok
        address = c(f"{p}_address")
        cases[f"{p}: address"] = ok & address.isNotNull() & ~gst.state_of_address(address).eqNullSafe(code)
        cases[f"{p}: state code"] = ok & (c(f"{p}_state_code") != code)
        if f"{p}_pan" in HEADER_FIELDS:
            cases[f"{p}: state name"] = ok & c(f"{p}_state").isNotNull() & ~c(f"{p}_state").eqNullSafe(gst.name_of_state(code))
            cases[f"{p}: PAN"] = ok & (c(f"{p}_pan") != gst.pan_of(g))
    cases |= {
        "place of supply": c("place_of_supply").isNotNull() & place.isNull(),
        "place of supply differs from ship-to": place != gst.state_of_address(c("ship_to_address")),
        **{f"{d} before PO": c(d) < c("po_date") for d in ("delivery_date", "amendment_date", "po_validity_date")},
        "quotation after PO": c("quotation_date") > c("po_date"),
        "no line items": c("n").isNull(),
        "numbering": (c("low") != 1) | (c("high") != c("n")),
        "subtotal": c("subtotal") != z("s_taxable_value"),
        **{f"{x}_total": c(f"{x}_total") != z(f"s_{x}_amount") for x in ("cgst", "sgst", "igst")},
        "total_tax": c("total_tax") != c("cgst_total") + c("sgst_total") + c("igst_total"),
        "regime": F.when(c("inter"), (c("cgst_total") != 0) | (c("sgst_total") != 0)).otherwise(c("igst_total") != 0),
        "grand_total": c("grand_total") != c("subtotal") + c("cgst_total") + c("sgst_total") + c("igst_total")
        + z("freight_charges") + z("other_charges") - z("discount_total") + z("round_off"),
        "round_off": F.abs(z("round_off")) > 0.5,
        "whole rupees": c("grand_total") != F.round("grand_total", 0),
        "positive total": c("grand_total") <= 0,
    }
    out = _rows(h.join(sums, "doc_id", "left"), cases)
    if words:
        said = c("amount_in_words").isNotNull() & ~c("amount_in_words").eqNullSafe(amount_to_words(c("grand_total")))
        out = out.unionByName(_rows(h, {"amount in words": said}))
    facts = lines.join(h.select("doc_id", "inter", "po_date"), "doc_id")
    share = lambda r, d: F.round(c("taxable_value") * c("gst_rate") * F.lit(r).cast(f"decimal({d + 1},{d})"), 2)
    exact = F.round(
        (c("quantity") * c("unit_rate") * (100 - F.coalesce(c("discount_pct"), F.lit(0).cast("decimal(5,2)")))).cast("decimal(28,7)")
        * F.lit(0.01).cast("decimal(3,2)"), 2,
    )
    half, whole = share(0.005, 3), share(0.01, 2)
    taxes = F.when(c("inter"), z("igst_amount")).otherwise(z("cgst_amount") + z("sgst_amount"))
    return out.unionByName(_rows(facts, {
        "line: not positive": (c("quantity") <= 0) | (c("unit_rate") <= 0),
        "line: taxable value": c("taxable_value") != exact,
        "line: igst": c("inter") & ~c("igst_amount").eqNullSafe(whole),
        "line: cgst/sgst": ~c("inter") & ~(c("cgst_amount").eqNullSafe(half) & c("sgst_amount").eqNullSafe(half)),
        "line: wrong kind of tax": F.when(c("inter"), c("cgst_amount").isNotNull() | c("sgst_amount").isNotNull()).otherwise(c("igst_amount").isNotNull()),
        "line: total": c("line_total") != c("taxable_value") + taxes,
        "line: delivery before PO": c("line_delivery_date") < c("po_date"),
    }))
