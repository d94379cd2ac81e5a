"""Computed fields, the eleven rules, and the report over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog import duck
from poledger.catalog.clean import WORDS_SQL
from poledger.catalog.pages import GROUND_VIEWS
from poledger.catalog.registry import query
from poledger.operators import compute, rules
from poledger.plans.validation import merged_for_formats, merged_from
from poledger.refdata import CRITICAL_HEADER_FIELDS, CURRENCIES, RULES

_SUPPLY = f"""
    SELECT doc_id, CASE WHEN vendor = place THEN 'intra' WHEN vendor <> place THEN 'inter' END AS supply
    FROM (SELECT doc_id,
        CASE WHEN {duck.gstin_ok("vendor_gstin")} THEN substr(vendor_gstin, 1, 2)
             WHEN {duck.known_state("vendor_state_code")} THEN vendor_state_code END AS vendor,
        coalesce({duck.state_of_place("place_of_supply")},
            CASE WHEN {duck.known_state("ship_to_state_code")} THEN ship_to_state_code END,
            CASE WHEN {duck.gstin_ok("ship_to_gstin")} THEN substr(ship_to_gstin, 1, 2) END) AS place
        FROM po_header) x"""
_TAXED = """
    SELECT l.* EXCLUDE (cgst_amount, sgst_amount, igst_amount), supply, po_date, buyer_gstin,
        CASE supply WHEN 'intra' THEN half WHEN 'inter' THEN NULL ELSE cgst_amount END AS cgst,
        CASE supply WHEN 'intra' THEN half WHEN 'inter' THEN NULL ELSE sgst_amount END AS sgst,
        CASE supply WHEN 'inter' THEN whole WHEN 'intra' THEN NULL ELSE igst_amount END AS igst
    FROM (SELECT *, CAST(round(taxable_value * gst_rate * CAST(0.005 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) AS half,
                    CAST(round(taxable_value * gst_rate * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS whole
          FROM po_line) l
    JOIN supply s ON s.doc_id = l.doc_id JOIN po_header h ON h.doc_id = l.doc_id"""
TAX_VIEWS = {"supply": _SUPPLY, "taxed": _TAXED}


def checked(rule: str, problems: str, detail: bool = False) -> str:
    """Verdict rows from problem rows (doc_id, hdr, call_id)."""
    return f"""
        SELECT h.doc_id, p.doc_id IS NULL AS passed, coalesce(n, 0) AS problems, target AS retry_target
        FROM po_header h LEFT JOIN (
            SELECT doc_id, count(*) AS n,
                CASE WHEN bool_or(hdr) AND count(call_id) > 0 THEN 'both' WHEN bool_or(hdr) THEN 'H'
                     WHEN count(DISTINCT call_id) = 1 THEN min(call_id)
                     WHEN count(DISTINCT call_id) > 1 THEN 'LI' END AS target
            FROM ({problems}) q GROUP BY doc_id) p ON p.doc_id = h.doc_id"""


def run_rule(t, rule: str, *columns: str):
    columns = columns or ("passed", "problems", "retry_target")
    merged = merged_for_formats(t) if rule == "formats" else merged_from(t, rule == "grounding")
    return rules.checks(merged, (rule,)).select("doc_id", *columns)


# --- computed fields
@query("supply_type", "SELECT doc_id, supply AS supply_type FROM supply", {"supply": _SUPPLY})
def supply_type(t):
    return compute.with_supply(t("po_header")).select("doc_id", "supply_type")


@query(
    "line_taxes",
    """SELECT doc_id, line_no, CAST(cgst AS DOUBLE) AS cgst, CAST(sgst AS DOUBLE) AS sgst,
              CAST(igst AS DOUBLE) AS igst FROM taxed""",
    TAX_VIEWS,
)
def line_taxes(t):
    _, lines = rules.line_facts(merged_from(t))
    return lines.select(
        "doc_id", "line_no",
        *[F.col(f"{x}_amount").cast("double").alias(x) for x in ("cgst", "sgst", "igst")],
    )


@query(
    "total_tax",
    """SELECT doc_id, CAST(cgst_total + sgst_total + igst_total AS DOUBLE) AS total_tax FROM po_header""",
)
def total_tax(t):
    return compute.with_total_tax(t.lazy("po_header").drop("total_tax").withColumn("total_tax", F.lit(None).cast("decimal(18,2)"))).select(
        "doc_id", F.col("total_tax").cast("double").alias("total_tax")
    )


@query(
    "hsn_summary",
    """SELECT doc_id, hsn_sac, CAST(gst_rate AS DOUBLE) AS gst_rate, CAST(sum(taxable_value) AS DOUBLE) AS taxable,
              CAST(sum(coalesce(cgst_amount, 0)) AS DOUBLE) AS cgst, CAST(sum(coalesce(sgst_amount, 0)) AS DOUBLE) AS sgst,
              CAST(sum(coalesce(igst_amount, 0)) AS DOUBLE) AS igst
       FROM po_line GROUP BY doc_id, hsn_sac, gst_rate""",
)
def hsn_summary(t):
    s = compute.hsn_summary(t("po_line"))
    return s.select("doc_id", "hsn_sac", *[F.col(c).cast("double").alias(c) for c in ("gst_rate", "taxable", "cgst", "sgst", "igst")])


# --- rules
P: dict[str, str] = {}
P["schema"] = (
    """SELECT doc_id, true AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM header_error
       UNION ALL SELECT doc_id, false, call_id FROM row_error
       UNION ALL SELECT doc_id, call_id = 'H', CASE WHEN call_id <> 'H' THEN call_id END FROM missing_call"""
    + "".join(
        f" UNION ALL SELECT doc_id, true, NULL FROM po_header h WHERE {f} IS NULL AND NOT EXISTS "
        f"(SELECT 1 FROM header_error e WHERE e.doc_id = h.doc_id AND e.field = '{f}')"
        for f in CRITICAL_HEADER_FIELDS
    )
)
_G = []
for _p in ("buyer", "vendor", "bill_to", "ship_to"):
    _ok = duck.gstin_ok(f"{_p}_gstin")
    _G.append(f"{_p}_gstin IS NOT NULL AND NOT {_ok}")
    _G.append(f"{_p}_state_code IS NOT NULL AND (NOT {duck.known_state(f'{_p}_state_code')} OR ({_ok} AND {_p}_state_code <> substr({_p}_gstin, 1, 2)))")
    if _p in ("buyer", "vendor"):
        _G.append(f"{_ok} AND {duck.state_of_place(f'{_p}_state')} <> substr({_p}_gstin, 1, 2)")
        _G.append(f"{_p}_pan IS NOT NULL AND (NOT {duck.pan_ok(f'{_p}_pan')} OR ({_ok} AND {_p}_pan <> substr({_p}_gstin, 3, 10)))")
P["gstin"] = " UNION ALL ".join(f"SELECT doc_id, true AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM po_header WHERE {c}" for c in _G)
P["tax_regime"] = """
    SELECT h.doc_id, true AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM po_header h JOIN supply s ON s.doc_id = h.doc_id
    WHERE supply IS NULL OR (supply = 'intra' AND coalesce(igst_total, 0) <> 0)
       OR (supply = 'inter' AND (coalesce(cgst_total, 0) <> 0 OR coalesce(sgst_total, 0) <> 0))"""
_EXPECTED = """CAST(round(CAST(quantity * unit_rate * (100 - coalesce(discount_pct, CAST(0 AS DECIMAL(5,2)))) AS DECIMAL(28,7))
    * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))"""
_TAXES = "coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0)"
P["line_arithmetic"] = f"""
    SELECT doc_id, false AS hdr, call_id FROM taxed WHERE abs(taxable_value - {_EXPECTED}) > 1
    UNION ALL SELECT doc_id, false, call_id FROM taxed WHERE supply IS NOT NULL AND abs(line_total - taxable_value - ({_TAXES})) > 1"""
P["formats"] = f"""
    SELECT doc_id, true AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM po_header WHERE delivery_date < po_date
    UNION ALL SELECT doc_id, true, NULL FROM po_header WHERE po_validity_date < po_date
    UNION ALL SELECT doc_id, true, NULL FROM po_header WHERE amendment_date < po_date
    UNION ALL SELECT doc_id, true, NULL FROM po_header WHERE quotation_date > po_date
    UNION ALL SELECT doc_id, true, NULL FROM po_header WHERE upper(currency) NOT IN ({duck.quoted(CURRENCIES)})
    UNION ALL SELECT doc_id, false, call_id FROM po_line WHERE NOT regexp_full_match(hsn_sac, '[0-9]{{4,8}}')
    UNION ALL SELECT l.doc_id, false, call_id FROM po_line l JOIN po_header h ON h.doc_id = l.doc_id WHERE line_delivery_date < po_date"""
P["amount_in_words"] = """
    SELECT h.doc_id, true AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM po_header h JOIN word_amount w ON w.doc_id = h.doc_id
    WHERE grand_total IS NOT NULL AND (problem IS NOT NULL OR NOT (amount = CAST(grand_total AS DOUBLE)
          OR (amount = floor(amount) AND amount = floor(CAST(grand_total AS DOUBLE)))))"""
P["masters"] = """
    SELECT doc_id, true AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM po_header WHERE buyer_gstin NOT IN (SELECT gstin FROM master_party)
    UNION ALL SELECT doc_id, true, NULL FROM po_header WHERE vendor_gstin NOT IN (SELECT gstin FROM master_party)
    UNION ALL SELECT l.doc_id, false, l.call_id FROM po_line l JOIN po_header h ON h.doc_id = l.doc_id
      WHERE EXISTS (SELECT 1 FROM master_item i WHERE substr(i.issuer_gstin, 3, 10) = substr(h.buyer_gstin, 3, 10))
        AND NOT EXISTS (SELECT 1 FROM master_item i WHERE substr(i.issuer_gstin, 3, 10) = substr(h.buyer_gstin, 3, 10)
                        AND i.item_code = l.item_code)"""
P["grounding"] = """
    SELECT v.doc_id, g.line_no IS NULL AS hdr, l.call_id FROM verdicts v
    JOIN ground_values g ON g.doc_id = v.doc_id AND g.value = v.value
    LEFT JOIN po_line l ON l.doc_id = g.doc_id AND l.line_no = g.line_no
    WHERE v.verdict = 'no'"""
P["duplicate_po"] = f"""
    SELECT h.doc_id, false AS hdr, CAST(NULL AS VARCHAR) AS call_id FROM po_header h
    WHERE EXISTS (SELECT 1 FROM master_processed m WHERE substr(m.issuer_gstin, 3, 10) = substr(h.buyer_gstin, 3, 10)
                  AND {duck.key_text("m.po_number")} = {duck.key_text("h.po_number")})"""
_WORDS = {"word_amount": WORDS_SQL}

for _rule, _views in {
    "schema": None, "gstin": None, "formats": None, "masters": None, "duplicate_po": None,
    "amount_in_words": _WORDS, "grounding": GROUND_VIEWS,
}.items():
    _name = {"amount_in_words": "check_amount_words", "duplicate_po": "check_duplicate"}.get(_rule, f"check_{_rule}")
    query(_name, checked(_rule, P[_rule]), _views)(lambda t, r=_rule: run_rule(t, r))


@query(
    "check_tax_regime",
    f"""SELECT c.doc_id, passed, retry_target, CASE WHEN passed THEN '' WHEN supply IS NULL
              THEN 'cannot tell intra- from inter-state: vendor state or place of supply unknown'
              WHEN supply = 'intra' THEN 'intra-state supply but igst_total is not 0'
              ELSE 'inter-state supply but ' || concat_ws(', ', CASE WHEN cgst_total <> 0 THEN 'cgst_total' END,
                    CASE WHEN sgst_total <> 0 THEN 'sgst_total' END) || ' is not 0' END AS detail
        FROM ({checked("tax_regime", P["tax_regime"])}) c JOIN supply s ON s.doc_id = c.doc_id
        JOIN po_header h ON h.doc_id = c.doc_id""",
    TAX_VIEWS,
)
def check_tax_regime(t):
    return run_rule(t, "tax_regime", "passed", "retry_target", "detail")


_ARITH_TEXT = f"""
    SELECT doc_id, line_no * 2 AS ord, 'line ' || line_no || ': taxable ' || CAST(taxable_value AS VARCHAR)
           || ' != qty x rate = ' || CAST({_EXPECTED} AS VARCHAR) AS txt
    FROM taxed WHERE abs(taxable_value - {_EXPECTED}) > 1
    UNION ALL
    SELECT doc_id, line_no * 2 + 1, 'line ' || line_no || ': line_total ' || CAST(line_total AS VARCHAR) || ' != '
           || CAST(CAST(taxable_value + {_TAXES} AS DECIMAL(18,2)) AS VARCHAR)
    FROM taxed WHERE supply IS NOT NULL AND abs(line_total - taxable_value - ({_TAXES})) > 1"""


@query(
    "check_line_arithmetic",
    f"""SELECT c.doc_id, passed, problems, retry_target, coalesce(texts || CASE WHEN problems > 5 THEN '; and '
              || CAST(problems - 5 AS VARCHAR) || ' more' ELSE '' END, '') AS detail
        FROM ({checked("line_arithmetic", P["line_arithmetic"])}) c LEFT JOIN (
            SELECT doc_id, string_agg(txt, '; ' ORDER BY ord) AS texts
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM ({_ARITH_TEXT}) a) b
            WHERE rn <= 5 GROUP BY doc_id) d ON d.doc_id = c.doc_id""",
    TAX_VIEWS,
)
def check_line_arithmetic(t):
    return run_rule(t, "line_arithmetic", "passed", "problems", "retry_target", "detail")


# Gaps by brute force: every expected number that is not there, and the rows next to it.
_STEPS = """
    SELECT doc_id, max(line_no) AS top, CASE WHEN bool_and(line_no % 10 = 0) THEN 10 ELSE 1 END AS step
    FROM po_line GROUP BY doc_id"""
_MISSING = """
    SELECT e.doc_id, e.n FROM (SELECT doc_id, CAST(unnest(range(step, top + 1, step)) AS INT) AS n FROM steps) e
    LEFT JOIN po_line l ON l.doc_id = e.doc_id AND l.line_no = e.n WHERE l.doc_id IS NULL"""
_GAP_CALLS = """
    SELECT DISTINCT doc_id, unnest([before_call, after_call]) AS call_id FROM (
        SELECT m.doc_id, m.n, max_by(l.call_id, l.line_no) FILTER (WHERE l.line_no < m.n) AS before_call,
               min_by(l.call_id, l.line_no) FILTER (WHERE l.line_no > m.n) AS after_call
        FROM missing_no m JOIN po_line l ON l.doc_id = m.doc_id GROUP BY m.doc_id, m.n) x"""
GAP_VIEWS = {"steps": _STEPS, "missing_no": _MISSING, "gap_calls": _GAP_CALLS}
_CALLS_TARGET = "CASE WHEN count(DISTINCT call_id) = 1 THEN min(call_id) WHEN count(DISTINCT call_id) > 1 THEN 'LI' END"


CONTINUITY_SQL = f"""SELECT h.doc_id, s.doc_id IS NOT NULL AND g.doc_id IS NULL AS passed,
               CASE WHEN s.doc_id IS NULL THEN 'LI' ELSE target END AS retry_target,
               CASE WHEN s.doc_id IS NULL THEN 'no line items' WHEN g.doc_id IS NULL THEN ''
                    ELSE 'missing line numbers [' || numbers || ']' END AS detail
        FROM po_header h LEFT JOIN steps s ON s.doc_id = h.doc_id
        LEFT JOIN (SELECT doc_id, string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n) AS numbers FROM (
                     SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM missing_no) r
                   WHERE rn <= 20 GROUP BY doc_id) g ON g.doc_id = h.doc_id
        LEFT JOIN (SELECT doc_id, {_CALLS_TARGET} AS target FROM gap_calls GROUP BY doc_id) c ON c.doc_id = h.doc_id"""


@query("check_continuity", CONTINUITY_SQL, GAP_VIEWS)
def check_continuity(t):
    return run_rule(t, "continuity", "passed", "retry_target", "detail")


_TOTALS = f"""
    SELECT h.doc_id, n_lines, supply,
        (n_lines > 0 AND abs(s.taxable - subtotal) > 1)::INT
        + (n_lines > 0 AND supply IS NOT NULL AND abs(s.cgst - cgst_total) > 1)::INT
        + (n_lines > 0 AND supply IS NOT NULL AND abs(s.sgst - sgst_total) > 1)::INT
        + (n_lines > 0 AND supply IS NOT NULL AND abs(s.igst - igst_total) > 1)::INT AS lv,
        coalesce((abs(subtotal + cgst_total + sgst_total + igst_total + coalesce(freight_charges, 0) + coalesce(other_charges, 0)
            + coalesce(round_off, 0) - coalesce(discount_total, 0) - grand_total) > 1)::INT, 0)
        + (abs(coalesce(round_off, 0)) > 1)::INT AS ho
    FROM po_header h JOIN supply p ON p.doc_id = h.doc_id LEFT JOIN (
        SELECT doc_id, count(*) AS n_lines, sum(taxable_value) AS taxable, sum(coalesce(cgst, 0)) AS cgst,
               sum(coalesce(sgst, 0)) AS sgst, sum(coalesce(igst, 0)) AS igst
        FROM taxed GROUP BY doc_id) s ON s.doc_id = h.doc_id"""
_INCOMPLETE = f"""
    SELECT doc_id, {_CALLS_TARGET} AS target FROM (
        SELECT doc_id, call_id FROM gap_calls UNION ALL SELECT doc_id, call_id FROM row_error
        UNION ALL SELECT doc_id, call_id FROM missing_call WHERE call_id <> 'H') x GROUP BY doc_id"""
TOTAL_VIEWS = {**TAX_VIEWS, **GAP_VIEWS, "totals": _TOTALS, "incomplete": _INCOMPLETE}


TOTALS_SQL = """SELECT t.doc_id, coalesce(lv, 0) + ho = 0 AS passed, coalesce(lv, 0) + ho AS problems,
              CASE WHEN coalesce(lv, 0) + ho = 0 THEN NULL WHEN lv > 0 AND ho = 0 THEN coalesce(target, 'both')
                   WHEN lv > 0 THEN 'both' ELSE 'H' END AS retry_target
       FROM totals t LEFT JOIN incomplete i ON i.doc_id = t.doc_id"""


@query("check_totals", TOTALS_SQL, TOTAL_VIEWS)
def check_totals(t):
    return run_rule(t, "totals")


# --- the report over all rules
_FAILS = " UNION ALL ".join(
    f"SELECT DISTINCT doc_id, {i} AS o, '{r}' AS rule FROM ({P[r]}) p{i}" for i, r in enumerate(RULES) if r in P
) + """ UNION ALL SELECT doc_id, 4, 'totals' FROM totals WHERE coalesce(lv, 0) + ho > 0
    UNION ALL SELECT DISTINCT doc_id, 5, 'continuity' FROM missing_no
    UNION ALL SELECT doc_id, 5, 'continuity' FROM po_header WHERE doc_id NOT IN (SELECT doc_id FROM po_line)"""
REPORT_VIEWS = {**_WORDS, **GROUND_VIEWS, **TOTAL_VIEWS, "fails": _FAILS}
REPORT_SQL = """
    SELECT h.doc_id, f.doc_id IS NULL AS passed, coalesce(failed_rules, '') AS failed_rules, CAST(11 AS BIGINT) AS checks
    FROM po_header h LEFT JOIN (SELECT doc_id, string_agg(rule, ',' ORDER BY o) AS failed_rules FROM fails GROUP BY doc_id) f
      ON f.doc_id = h.doc_id"""


@query("validation_report", REPORT_SQL, REPORT_VIEWS)
def validation_report(t):
    return rules.report(rules.checks(merged_from(t, grounding=True)))


@query(
    "rule_failure_counts",
    "SELECT rule, count(*) AS docs FROM fails GROUP BY rule",
    REPORT_VIEWS,
)
def rule_failure_counts(t):
    m = merged_from(t, grounding=True)
    return rules.checks(m).filter("not passed").groupBy("rule").agg(F.count("*").alias("docs"))


# --- exact audit of the truth tables
@query("consistency_audit")
def consistency_audit(t):
    from poledger.operators import audit

    return audit.consistency(t("po_header"), t("po_line")).groupBy("violation").agg(F.count("*").alias("n"))


_LINE_AUDIT = f"""
    SELECT doc_id, 'line: taxable value' AS violation FROM po_line WHERE taxable_value <> {_EXPECTED}
    UNION ALL SELECT doc_id, 'quotation after PO' FROM po_header WHERE quotation_date > po_date
    UNION ALL SELECT doc_id, 'igst_total' FROM po_header h WHERE igst_total <> coalesce((SELECT sum(coalesce(igst_amount, 0)) FROM po_line l WHERE l.doc_id = h.doc_id), 0)
    UNION ALL SELECT h.doc_id, 'numbering' FROM po_header h JOIN (SELECT doc_id, min(line_no) AS lo, max(line_no) AS hi, count(*) AS n FROM po_line GROUP BY doc_id) s
      ON s.doc_id = h.doc_id WHERE lo <> 1 OR hi <> n
    UNION ALL SELECT doc_id, 'buyer: invalid GSTIN' FROM po_header WHERE NOT {duck.gstin_ok("buyer_gstin")}
    UNION ALL SELECT doc_id, 'round_off' FROM po_header WHERE abs(coalesce(round_off, 0)) > 0.5
    UNION ALL SELECT h.doc_id, 'no line items' FROM po_header h WHERE doc_id NOT IN (SELECT doc_id FROM po_line)"""
_AUDITED = ("line: taxable value", "quotation after PO", "igst_total", "numbering", "buyer: invalid GSTIN", "round_off", "no line items")


@query("consistency_audit_core", _LINE_AUDIT)
def consistency_audit_core(t):
    from poledger.operators import audit

    found = audit.consistency(t("po_header"), t("po_line"), words=False)
    return found.filter(F.col("violation").isin(*_AUDITED))
