"""Merged answers to verdicts."""

from __future__ import annotations

from poledger.catalog.registry import Tables
from poledger.operators import pages
from poledger.operators.rules import Merged
from poledger.plans.staging import settle


def merged_for_formats(t: Tables) -> Merged:
    """What the rule on formats reads, a few columns of header and lines once: no whole table is written for it."""
    return Merged(t.lazy("po_header"), t.lazy("po_line"), t("header_error"), t("row_error"), t("missing_call"))


def merged_from(t: Tables, grounding: bool = False) -> Merged:
    """The bridge's merged extraction with master data (and grounding verdicts on request)."""
    header, lines = t("po_header"), t("po_line")
    verdicts = None
    if grounding:
        verdicts = settle(
            pages.ground(pages.grounding_values(header, lines), pages.page_features(t("page_text"))), "verdicts"
        )
    return Merged(
        header, lines, t("header_error"), t("row_error"), t("missing_call"),
        t("master_party"), t("master_item"), t("master_processed"), verdicts,
    )
