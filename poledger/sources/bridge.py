"""Purchase-order tables derived from the driver's parquet tables.

Each table is one SELECT in the SQL both Spark and DuckDB read, so a query and its counterpart
start from the same rows. Choices that stand for chance (defects, variants) hang on key
remainders. Nothing is collected; tables that many queries read are written once in the shared folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from poledger.plans.staging import place, write
from poledger.refdata import (
    ALPHANUMERIC,
    CRITICAL_HEADER_FIELDS,
    HEADER_FIELDS,
    ROW_COLUMNS,
    STATES,
    header_sql_type,
)

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NL = "chr(10)"
ONES = ("One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen "
        "Fifteen Sixteen Seventeen Eighteen Nineteen")  # fmt: skip
TENS = "Ten Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety"


# --- SQL text helpers (both dialects) -------------------------------------------------------
def intdiv(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def text(a: str) -> str:
    return f"CAST({a} AS STRING)"


def pad(a: str, width: int) -> str:
    return f"lpad({text(a)}, {width}, '0')"


def small_words(n: str) -> str:
    """Words of 0..99 (blank for 0)."""
    tens = f"split_part('{TENS}', ' ', CAST(floor({n} / 10) AS INT))"
    ones = f"split_part('{ONES}', ' ', CAST({n} % 10 AS INT))"
    return (
        f"CASE WHEN {n} = 0 THEN '' WHEN {n} < 20 THEN split_part('{ONES}', ' ', CAST({n} AS INT)) "
        f"WHEN {n} % 10 = 0 THEN {tens} ELSE {tens} || ' ' || {ones} END"
    )


def rupee_words(n: str) -> str:
    """Indian words of a whole amount below a hundred crore."""
    groups = [(10_000_000, 100, "Crore"), (100_000, 100, "Lakh"), (1_000, 100, "Thousand"),
              (100, 10, "Hundred")]
    parts = []
    for size, span, name in groups:
        g = f"(CAST(floor({n} / {size}) AS BIGINT) % {span})"
        parts.append(f"CASE WHEN {g} = 0 THEN '' ELSE ' ' || ({small_words(g)}) || ' {name}' END")
    last = f"({n} % 100)"
    parts.append(f"CASE WHEN {last} = 0 THEN '' ELSE ' ' || ({small_words(last)}) END")
    return "'Rupees' || " + " || ".join(parts) + " || ' Only'"


def indian(x: str, decimals: int = 2) -> str:
    """Digit grouping 12,34,567.80 of a number with that many decimals."""
    s, tail = text(x), decimals + 1
    w = f"substr({s}, 1, length({s}) - {tail})"
    groups, cases = f"substr({w}, length({w}) - 2, 3) || substr({s}, length({s}) - {decimals}, {tail})", [f"WHEN length({w}) <= 3 THEN {s}"]
    for digits in range(5, 17, 2):
        groups = f"',' || {groups}"
        cases.append(f"WHEN length({w}) <= {digits} THEN substr({w}, 1, length({w}) - {digits - 2}) || {groups}")
        groups = f"substr({w}, length({w}) - {digits - 1}, 2) || {groups}"
    return f"CASE {' '.join(cases)} END"


def json_text(a: str) -> str:
    return f"""CASE WHEN {a} IS NULL THEN 'null' ELSE '"' || {text(a)} || '"' END"""


def json_number(a: str) -> str:
    return f"coalesce({text(a)}, 'null')"


def _checksum(body: str) -> str:
    """GSTIN check value (0..35) of a 14-character body: even places count double, with the
    digit sum in base 36."""
    terms = []
    for i in range(1, 15):
        v = f"(instr('{ALPHANUMERIC}', substr({body}, {i}, 1)) - 1)"
        terms.append(v if i % 2 else f"(2 * {v} - CASE WHEN {v} >= 18 THEN 35 ELSE 0 END)")
    return f"((36 - ({' + '.join(terms)}) % 36) % 36)"


def _party(role: str, key: str, name: str, nation: str, table: str, wrong: int) -> dict[str, str]:
    letter = f"chr(CAST(65 + {intdiv(key, 10000)} % 26 AS INT))"
    stem = {"B": "buyer", "V": "vendor"}[role]
    return {
        f"{stem}_pan": f"""
            SELECT {key} AS key, {name} AS name,
                   CASE WHEN {nation} < 24 THEN {pad(nation + ' + 1', 2)} ELSE '27' END AS state_code,
                   'A{role}' || {letter} || 'CX' || {pad(key + ' % 10000', 4)} || 'K' AS pan
            FROM {table}""",
        f"{stem}_check": f"""
            SELECT key, name, state_code, pan,
                   ({_checksum("(state_code || pan || '1Z')")}
                    + CASE WHEN {wrong} > 0 AND key % {max(wrong, 1)} = 0 THEN 1 ELSE 0 END) % 36
                   AS check_value
            FROM {stem}_pan""",
        stem: f"""
            SELECT p.key, p.name, p.state_code, s.name AS state, p.pan,
                   p.state_code || p.pan || '1Z'
                   || substr('{ALPHANUMERIC}', CAST(p.check_value + 1 AS INT), 1) AS gstin
            FROM {stem}_check p JOIN states s ON s.code = p.state_code""",
    }


PAGE_OF_LINE = "CAST(1 + floor((l_linenumber - 1) / 4) AS INT)"

TABLES: dict[str, str] = {
    "states": "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{n}')" for c, n in STATES.items())
    + ") AS t(code, name)",
    **_party("B", "c_custkey", "c_name", "c_nationkey", "customer", 29),
    **_party("V", "s_suppkey", "s_name", "s_nationkey", "supplier", 0),
    "first_line": """
        SELECT l_orderkey, l_suppkey FROM (
            SELECT l_orderkey, l_suppkey, row_number() OVER (
                PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
            FROM lineitem) x
        WHERE rn = 1""",
    # One row per order: who buys from whom, where, when.
    "po_party": """
        SELECT o_orderkey AS doc_id, o_custkey, o_orderpriority,
               CAST(o_orderdate AS DATE) AS po_date,
               CAST(o_totalprice AS DECIMAL(15,2)) AS order_total,
               b.name AS buyer_name, b.state_code AS buyer_state_code, b.state AS buyer_state,
               b.pan AS buyer_pan, b.gstin AS buyer_gstin,
               v.key AS vendor_key, v.name AS vendor_name, v.state_code AS vendor_state_code,
               v.state AS vendor_state, v.pan AS vendor_pan, v.gstin AS vendor_gstin
        FROM orders
        JOIN buyer b ON b.key = o_custkey
        LEFT JOIN first_line f ON f.l_orderkey = o_orderkey
        LEFT JOIN vendor v ON v.key = f.l_suppkey""",
    # Every printed row, repeated line numbers included.
    "raw_line": f"""
        SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS part_key,
               l_suppkey AS supp_key, {PAGE_OF_LINE} AS page_no,
               'LI-p' || CAST({PAGE_OF_LINE} AS STRING) AS call_id,
               p_brand || '-' || CAST(p_partkey AS STRING) AS item_code, p_name AS description,
               CASE WHEN p_partkey % 37 = 0 THEN '73A8'
                    ELSE lpad(CAST(p_partkey % 1000000 + 100000 AS STRING), 6, '0') END AS hsn_sac,
               CAST(l_quantity AS DECIMAL(15,3)) AS quantity,
               CASE p_partkey % 4 WHEN 0 THEN 'Nos' WHEN 1 THEN 'Kg' WHEN 2 THEN 'Mtr' END AS uom,
               CAST(p_retailprice AS DECIMAL(15,2)) AS unit_rate,
               CASE WHEN l_discount > 0 THEN CAST(CAST(l_discount AS DECIMAL(4,2)) * 100
                    AS DECIMAL(5,2)) END AS discount_pct,
               CAST(CASE WHEN l_tax < 0.03 THEN 5 ELSE 18 END AS DECIMAL(5,2)) AS gst_rate,
               CAST(round(CAST(CAST(l_quantity AS DECIMAL(15,3)) * CAST(p_retailprice AS DECIMAL(15,2))
                    * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(5,2)))
                    AS DECIMAL(28,7)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))
               + CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN CAST(5 AS DECIMAL(18,2))
                      ELSE CAST(0 AS DECIMAL(18,2)) END AS taxable_value,
               CASE WHEN p_partkey % 3 > 0 THEN CAST(l_shipdate AS DATE) END AS ship_date
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    # Every row with a number of its own (some orders skip the second number, some count in tens);
    # pages by place. Then taxes by supply type.
    "line_once": f"""
        SELECT doc_id, CAST((n + CASE WHEN doc_id % 13 = 4 AND n >= 2 THEN 1 ELSE 0 END)
                   * CASE WHEN doc_id % 14 = 3 THEN 10 ELSE 1 END AS INT) AS line_no, {PAGE_OF_LINE.replace("l_linenumber", "n")} AS page_no,
               'LI-p' || CAST({PAGE_OF_LINE.replace("l_linenumber", "n")} AS STRING) AS call_id, part_key, item_code, description, hsn_sac,
               quantity, uom, unit_rate, discount_pct, gst_rate, taxable_value, ship_date
        FROM (SELECT r.*, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part_key, supp_key, quantity,
                  taxable_value, gst_rate, ship_date, discount_pct) AS INT) AS n
              FROM raw_line r) x""",
    "po_line": """
        SELECT doc_id, line_no, page_no, call_id, item_code, description, hsn_sac, quantity, uom,
               unit_rate, discount_pct, taxable_value, gst_rate, cgst_amount, sgst_amount,
               igst_amount,
               CAST(taxable_value + coalesce(cgst_amount, 0) + coalesce(sgst_amount, 0)
                    + coalesce(igst_amount, 0)
                    + CASE WHEN (doc_id * 3 + line_no) % 91 = 0 THEN 7 ELSE 0 END
                    AS DECIMAL(18,2)) AS line_total,
               line_delivery_date
        FROM (
            SELECT l.doc_id, line_no, page_no, call_id, item_code, description, hsn_sac, quantity,
                   uom, unit_rate, discount_pct, CAST(taxable_value AS DECIMAL(18,2)) AS taxable_value,
                   gst_rate,
                   CASE WHEN vendor_state_code = buyer_state_code THEN CAST(round(taxable_value
                        * gst_rate * CAST(0.005 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) END AS cgst_amount,
                   CASE WHEN vendor_state_code = buyer_state_code THEN CAST(round(taxable_value
                        * gst_rate * CAST(0.005 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) END AS sgst_amount,
                   CASE WHEN vendor_state_code <> buyer_state_code THEN CAST(round(taxable_value
                        * gst_rate * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) END AS igst_amount,
                   CASE WHEN ship_date IS NOT NULL THEN po_date + CAST(part_key % 50 AS INT)
                        - CASE WHEN (l.doc_id + line_no) % 83 = 0 THEN 60 ELSE 0 END
                   END AS line_delivery_date
            FROM line_once l JOIN po_party p ON p.doc_id = l.doc_id) t""",
    "line_sums": """
        SELECT doc_id, CAST(sum(taxable_value) AS DECIMAL(18,2)) AS subtotal,
               CAST(sum(coalesce(cgst_amount, 0)) AS DECIMAL(18,2)) AS cgst_total,
               CAST(sum(coalesce(sgst_amount, 0)) AS DECIMAL(18,2)) AS sgst_total,
               CAST(sum(coalesce(igst_amount, 0)) AS DECIMAL(18,2)) AS igst_total
        FROM po_line GROUP BY doc_id""",
    "po_base": """
        SELECT p.*, s.subtotal, s.cgst_total, s.sgst_total, s.igst_total,
               CAST(CASE WHEN p.doc_id % 4 = 0 THEN 250.25 END AS DECIMAL(18,2)) AS freight_charges,
               CAST(CASE WHEN p.doc_id % 9 = 0 THEN 100 END AS DECIMAL(18,2)) AS discount_total,
               CAST(s.subtotal + s.cgst_total + s.sgst_total + s.igst_total
                    + CASE WHEN p.doc_id % 4 = 0 THEN CAST(250.25 AS DECIMAL(18,2))
                           ELSE CAST(0 AS DECIMAL(18,2)) END
                    - CASE WHEN p.doc_id % 9 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS net
        FROM po_party p LEFT JOIN line_sums s ON s.doc_id = p.doc_id""",
}

# How each header field of the truth is derived; the other fields are absent.
_FY = ("CASE WHEN month(po_date) >= 4 THEN year(po_date) ELSE year(po_date) - 1 END")
_HEADER_SQL = {
    "po_number": f"'PO/' || {text(_FY)} || '-' || {pad('(' + _FY + ' + 1) % 100', 2)} || '/' || {pad('doc_id', 7)}",
    "po_date": "po_date",
    "amendment_no": "CASE WHEN doc_id % 15 = 0 THEN 'A-' || CAST(doc_id % 7 AS STRING) END",
    "amendment_date": "CASE WHEN doc_id % 15 = 0 THEN po_date + CAST(doc_id % 9 AS INT) - 2 END",
    "quotation_ref": "CASE WHEN doc_id % 3 = 0 THEN 'Q ' || CAST(doc_id AS STRING) END",
    "quotation_date": "CASE WHEN doc_id % 3 = 0 THEN po_date - CAST(doc_id % 20 AS INT) + 1 END",
    "currency": "CASE WHEN doc_id % 37 = 0 THEN 'XYZ' WHEN doc_id % 5 = 0 THEN 'inr' ELSE 'INR' END",
    "delivery_date": "CASE WHEN doc_id % 53 <> 0 THEN po_date + CAST(doc_id % 45 AS INT) "
    "- CASE WHEN doc_id % 61 = 0 THEN 50 ELSE 0 END END",
    "po_validity_date": "CASE WHEN doc_id % 2 = 0 THEN po_date + 90 END",
    "buyer_name": "buyer_name",
    "buyer_address": "'Plot ' || CAST(doc_id % 90 + 10 AS STRING) || ', ' || buyer_state",
    "buyer_gstin": "buyer_gstin",
    "buyer_pan": "CASE WHEN doc_id % 47 = 0 THEN 'ABCDX1234K' WHEN doc_id % 49 = 0 THEN 'ABCCX1234K' ELSE buyer_pan END",
    "buyer_state": "CASE WHEN doc_id % 57 = 0 THEN 'Kerala' ELSE buyer_state END",
    "buyer_state_code": "CASE WHEN doc_id % 63 = 0 THEN '77' ELSE buyer_state_code END",
    "buyer_contact_person": "CASE WHEN doc_id % 4 > 0 THEN 'Desk ' || CAST(o_custkey AS STRING) END",
    "buyer_phone": f"'+91 98' || {pad('o_custkey % 1000', 3)} || ' ' || {pad('o_custkey * 7 % 100000', 5)}",
    "buyer_email": "'Buy' || CAST(o_custkey AS STRING) || '@Example.co.in'",
    "vendor_name": "vendor_name",
    "vendor_code": "'V' || CAST(vendor_key AS STRING)",
    "vendor_address": "'Shed ' || CAST(vendor_key % 40 + 1 AS STRING) || ', ' || vendor_state",
    "vendor_gstin": "vendor_gstin",
    "vendor_pan": "vendor_pan",
    "vendor_state": "vendor_state",
    "vendor_state_code": "vendor_state_code",
    "bill_to_name": "buyer_name",
    "bill_to_gstin": "CASE WHEN doc_id % 2 = 1 THEN buyer_gstin END",
    "bill_to_state_code": "buyer_state_code",
    "ship_to_name": "buyer_name",
    "ship_to_address": "CASE WHEN doc_id % 2 = 0 THEN 'Gate 4, ' || buyer_state END",
    "ship_to_gstin": "CASE WHEN doc_id % 59 <> 0 THEN buyer_gstin END",
    "ship_to_state_code": "CASE WHEN doc_id % 59 <> 0 AND doc_id % 4 = 1 THEN buyer_state_code END",
    "payment_terms": "'Net ' || CAST(doc_id % 4 * 15 + 15 AS STRING) || ' days.'",
    "freight_terms": "CASE WHEN doc_id % 4 = 0 THEN 'Extra at actuals' END",
    "place_of_supply": "CASE WHEN doc_id % 59 = 0 OR doc_id % 7 = 3 THEN NULL WHEN doc_id % 3 = 0 "
    "THEN buyer_state || ' (' || buyer_state_code || ')' WHEN doc_id % 3 = 1 "
    "THEN buyer_state_code || '-' || buyer_state ELSE buyer_state END",
    "subtotal": "subtotal",
    "discount_total": "discount_total",
    "freight_charges": "freight_charges",
    "cgst_total": "cgst_total",
    "sgst_total": "sgst_total",
    "igst_total": "CASE WHEN doc_id % 73 = 0 THEN igst_total + 10 ELSE igst_total END",
    "total_tax": "cgst_total + sgst_total + igst_total",
    "round_off": "CAST(round(net, 0) - net + CASE WHEN doc_id % 79 = 0 THEN 3 ELSE 0 END AS DECIMAL(18,2))",
    "grand_total": "CAST(round(net, 0) + CASE WHEN doc_id % 31 = 0 THEN 50 ELSE 0 END AS DECIMAL(18,2))",
    "amount_in_words": "CASE WHEN doc_id % 8 = 5 THEN NULL WHEN doc_id % 67 = 0 THEN 'Rupees about five Only' "
    "WHEN doc_id % 69 = 0 THEN 'Rupees One Hundred Only' ELSE "
    + rupee_words("CAST(round(net, 0) AS BIGINT)") + " END",
    "prepared_by": "'Clerk ' || CAST(doc_id % 12 AS STRING)",
}
TABLES["po_header"] = (
    "SELECT doc_id, "
    + ", ".join(
        f"CAST({_HEADER_SQL.get(f, 'NULL')} AS {header_sql_type(f)}) AS {f}" for f in HEADER_FIELDS
    )
    + " FROM po_base"
)

TABLES |= {
    # Dates as eight printers would set them; two of the eight are refused on purpose.
    "printed_date": f"""
        SELECT doc_id, po_date, CASE doc_id % 8
            WHEN 0 THEN CAST(po_date AS STRING)
            WHEN 1 THEN {pad('day(po_date)', 2)} || '/' || {text('month(po_date)')} || '/' || {text('year(po_date)')}
            WHEN 2 THEN {text('day(po_date)')} || '.' || {pad('month(po_date)', 2)} || '.' || {pad('year(po_date) % 100', 2)}
            WHEN 3 THEN ' ' || {text('day(po_date)')} || '  {{M}} , ' || {text('year(po_date)')}
            WHEN 4 THEN {text('day(po_date)')} || 'th-{{M}}-' || {text('year(po_date)')}
            WHEN 5 THEN '{{M}} ' || {pad('day(po_date)', 2)} || ', ' || {text('year(po_date)')}
            WHEN 6 THEN {text('month(po_date)')} || '/' || {text('day(po_date)')} || '/' || {text('year(po_date)')}
            ELSE '31-02-' || {text('year(po_date)')} END AS printed
        FROM po_party""".replace("{M}", "' || split_part('Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec', ' ', CAST(month(po_date) AS INT)) || '"),
    "header_error": """
        SELECT o_orderkey AS doc_id, 'delivery_date' AS field, 'unrecognised date format' AS error
        FROM orders WHERE o_orderkey % 53 = 0""",
    "row_error": f"""
        SELECT l_orderkey AS doc_id, 'LI-p' || CAST({PAGE_OF_LINE} AS STRING) AS call_id,
               CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS line_no,
               'expected 12 cells, got 11' AS message,
               CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS seq
        FROM lineitem WHERE (l_orderkey * 7 + l_linenumber) % 101 = 0""",
    "missing_call": """
        SELECT o_orderkey AS doc_id, 'LI-p2' AS call_id FROM orders WHERE o_orderkey % 97 = 0
        UNION ALL SELECT o_orderkey, 'H' FROM orders WHERE o_orderkey % 89 = 0""",
    # Master data.
    "master_party": """
        SELECT gstin, name, state_code, 'buyer' AS role FROM buyer WHERE key % 43 <> 0
        UNION ALL SELECT gstin, name, state_code, 'vendor' FROM vendor WHERE key % 43 <> 0""",
    "master_item": """
        SELECT DISTINCT p.buyer_gstin AS issuer_gstin, l.item_code
        FROM raw_line l JOIN po_party p ON p.doc_id = l.doc_id
        WHERE l.part_key % 47 <> 0 AND p.o_custkey % 41 <> 0""",
    "master_processed": """
        SELECT buyer_gstin AS issuer_gstin, po_number FROM po_header WHERE doc_id % 53 = 1""",
    # Runs.
    "manifest": """
        SELECT 'PO_' || CAST(o_orderkey AS STRING) || suffix AS id,
               'PO_' || CAST(o_orderkey AS STRING) AS base_id, o_orderkey AS doc_id, variant,
               'L' || CAST(o_custkey % 6 + 1 AS STRING) AS layout,
               CASE WHEN o_custkey % 10 < 7 THEN 'True' ELSE 'False' END AS issuer_frequent,
               CASE WHEN o_orderkey % 4 = 0 THEN 'dev' ELSE 'test' END AS split,
               CASE variant WHEN 'N' THEN 'native native' WHEN 'S' THEN 'scanned scanned'
                    ELSE 'native scanned' END AS page_kinds
        FROM orders JOIN (VALUES ('N', '', 1), ('S', '_S', 2), ('M', '_M', 10)) AS v(variant, suffix, step)
             ON o_orderkey % step = 0""",
    "pred_header": "SELECT h.doc_id, "
    + ", ".join(
        {
            "po_number": "CASE WHEN h.doc_id % 7 = 0 THEN lower(po_number) ELSE po_number END AS po_number",
            "vendor_gstin": "CASE WHEN h.doc_id % 11 = 0 THEN substr(vendor_gstin, 1, 14) || '*' ELSE vendor_gstin END AS vendor_gstin",
            "buyer_name": "CASE WHEN h.doc_id % 13 = 0 THEN NULL WHEN h.doc_id % 3 = 0 THEN upper(buyer_name) || ' ,' ELSE buyer_name END AS buyer_name",
            "amendment_no": "CASE WHEN h.doc_id % 17 = 0 THEN 'X-123' ELSE amendment_no END AS amendment_no",
            "payment_terms": "CASE WHEN h.doc_id % 29 = 0 THEN 'days net 15 30' ELSE payment_terms END AS payment_terms",
        }.get(f, f)
        for f in HEADER_FIELDS
    )
    + " FROM po_header h WHERE h.doc_id % 41 <> 0",
    "pred_line": """
        SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE line_no END AS line_no, line_no AS idx,
               item_code,
               CASE WHEN doc_id % 3 = 0 THEN upper(description) || '.'
                    WHEN (doc_id + line_no) % 31 = 0 THEN 'old ' || description
                    ELSE description END AS description, hsn_sac,
               CASE WHEN (doc_id + line_no) % 37 = 0 THEN quantity + 1 ELSE quantity END AS quantity,
               uom, unit_rate, discount_pct, taxable_value, gst_rate,
               cgst_amount, sgst_amount, igst_amount, line_total, line_delivery_date
        FROM po_line WHERE doc_id % 41 <> 0 AND NOT (doc_id % 19 = 0 AND line_no = 2)
        UNION ALL
        SELECT doc_id, line_no + 100, line_no + 100, item_code, 'ghost ' || description, hsn_sac, quantity, uom,
               unit_rate, discount_pct, taxable_value, gst_rate, cgst_amount, sgst_amount, igst_amount,
               line_total, line_delivery_date
        FROM po_line WHERE doc_id % 43 = 0 AND line_no = 1 AND doc_id % 41 <> 0""",
    "records": """
        SELECT m.id AS doc_id, m.variant, m.doc_id AS po_id,
               CASE WHEN m.doc_id % 41 = 0 THEN 'parse_error' WHEN m.doc_id % 6 = 1 THEN 'needs_review'
                    ELSE 'completed' END AS status,
               CAST(o_totalprice AS DECIMAL(15,2)) AS total_ms,
               CAST(2 + m.doc_id % 4 AS INT) AS calls,
               m.doc_id % 1000 * 3 AS prompt_tokens, m.doc_id % 1000 * 2 AS completion_tokens,
               CASE WHEN m.doc_id % 2 = 1 THEN m.doc_id % 1000 END AS reasoning_tokens,
               m.doc_id % 97 = 1 AS reasoning_estimated,
               CASE WHEN m.doc_id % 8 = 1 THEN 'LI' END AS retried_call
        FROM manifest m JOIN orders ON o_orderkey = m.doc_id""",
    # Text layers: a printed header block, item blocks, a terms page; then free prose.
    "line_block": f"""
        SELECT doc_id, page_no,
               string_agg({text('line_no')} || ' ' || item_code || ' ' || description || ' '
                 || hsn_sac || ' ' || {text('quantity')} || ' ' || ({indian('taxable_value')}) || ' '
                 || ({indian('line_total')}), {NL}) WITHIN GROUP (ORDER BY line_no) AS block
        FROM po_line WHERE doc_id % 71 <> line_no % 71
        GROUP BY doc_id, page_no""",
    "page_text": f"""
        SELECT h.doc_id, 1 AS page_no,
               'PURCHASE ORDER' || {NL} || 'PO No: ' || po_number || {NL} || 'Date: '
               || {pad('day(po_date)', 2)} || '/' || {pad('month(po_date)', 2)} || '/' || {text('year(po_date)')}
               || {NL} || buyer_name || {NL} || 'GSTIN ' || CASE WHEN h.doc_id % 16 = 0 THEN '' ELSE buyer_gstin END
               || {NL} || 'Phone: ' || buyer_phone || {NL} || lower(buyer_email) || {NL}
               || coalesce('Vendor ' || vendor_name || {NL} || 'GSTIN: ' || vendor_gstin || {NL}
                           || 'PAN ' || vendor_pan || {NL}, '')
               || coalesce('Place of supply ' || place_of_supply || {NL}, '')
               || coalesce(block, '') || {NL}
               || coalesce('Grand total ' || ({indian('grand_total')}) || {NL}, '') AS text
        FROM po_header h LEFT JOIN line_block b ON b.doc_id = h.doc_id AND b.page_no = 1
        UNION ALL
        SELECT doc_id, page_no,
               CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Purchase Order continued' || {NL} || block || {NL}
                    || 'carried forward, prices in rupees, see page one' END
        FROM line_block WHERE page_no > 1
        UNION ALL
        SELECT o_orderkey, 9,
               'Terms and Conditions' || {NL} || '1. Goods remain ours until paid in full' || {NL}
               || '2. Disputes go to the courts of the seat' || {NL} || '3. No verbal changes count'
               || CASE WHEN o_orderkey % 12 = 0 THEN {NL} || 'Payment: within 30 days' ELSE '' END
        FROM orders WHERE o_orderkey % 6 = 0
        UNION ALL
        SELECT 1000000000000 + doc_id, 1, text FROM documents""",
}


# --- Raw answers of the extraction calls -----------------------------------------------------
_ROW_JSON = " || ', ' || ".join(
    json_number(c) if c in ("line_no", "quantity", "unit_rate", "discount_pct", "taxable_value",
                            "gst_rate", "line_total") else json_text(c)
    for c in ROW_COLUMNS
)
_SHORT_JSON = ["po_number", "po_date", "buyer_name", "buyer_gstin", "vendor_name", "vendor_gstin",
               "buyer_state_code", "place_of_supply", "subtotal", "cgst_total", "sgst_total",
               "igst_total", "grand_total", "round_off", "delivery_date", "currency"]


def _header_json() -> str:
    from poledger.refdata import HEADER_KIND, SHORT_TO_FULL

    short = {full: s for s, full in SHORT_TO_FULL.items()}
    parts = []
    for f in _SHORT_JSON:
        value = (
            text(f) if HEADER_KIND[f] == "money" else f"'\"' || {text(f)} || '\"'"
        )
        drop = f"doc_id % 25 = 0 AND '{f}' IN ('igst_total', 'round_off')"
        parts.append(f"CASE WHEN {drop} THEN '' ELSE coalesce(', \"{short[f]}\": ' || {value}, '') END")
    odd = ("CASE WHEN doc_id % 27 = 0 THEN ', \"foo\": 1' ELSE '' END"
           " || CASE WHEN doc_id % 33 = 0 THEN ', \"amd_dt\": \"31/02/2026\"' ELSE '' END"
           " || CASE WHEN doc_id % 35 = 0 THEN ', \"freight\": \"about 5\"' ELSE '' END")
    return "'{\"prep_by\": \"desk\"' || " + " || ".join(parts) + " || " + odd + " || '}'"


def _whole_header(more: str, odd: bool = False) -> str:
    """JSON of all header values; `more` is added to the grand total, `odd` spoils some dates."""
    from poledger.refdata import HEADER_KIND, SHORT_TO_FULL

    short = {full: s for s, full in SHORT_TO_FULL.items()}
    parts = []
    for f in [x for x in HEADER_FIELDS if x != "prepared_by"]:
        value = f"CAST({f} + {more} AS DECIMAL(18,2))" if f == "grand_total" else f
        given = text(value) if HEADER_KIND[f] == "money" else f"'\"' || {text(value)} || '\"'"
        if odd and f == "delivery_date":
            given = f"CASE WHEN doc_id % 33 = 5 THEN '\"31/02/2026\"' ELSE {given} END"
        parts.append(f"coalesce(', \"{short.get(f, f)}\": ' || {given}, '')")
    # a value that every order has comes first, so that all others may follow a comma
    return f"'{{\"{short['prepared_by']}\": \"' || prepared_by || '\"' || " + " || ".join(parts) + " || '}'"


TABLES |= {
    "answer_row": f"""
        SELECT r.doc_id, r.page_no, r.seq, r.part_key, r.supp_key,
               CASE WHEN (r.doc_id * 7 + r.seq) % 101 = 0 THEN '[1, 2, 3]'
                    WHEN (r.doc_id * 7 + r.seq) % 103 = 0 THEN '"oops"'
                    ELSE '[' || {_ROW_JSON} || ']' END AS row_json
        FROM (SELECT doc_id, page_no, part_key, supp_key,
                     line_no AS seq,
                     CASE WHEN (doc_id + part_key) % 29 = 0 THEN NULL ELSE line_no END AS line_no,
                     item_code, description, hsn_sac, quantity, uom, unit_rate, discount_pct,
                     taxable_value, gst_rate, taxable_value AS line_total, ship_date AS line_delivery_date
              FROM raw_line) r""",
    # A continuation fragment opens page 2 of some answers.
    "line_answer": """
        SELECT doc_id, page_no,
               '{"rows": ['
               || CASE WHEN doc_id % 4 = 0 AND page_no = 2 THEN
                  '[null, null, "with seal kit", null, null, "Set", null, 2.50, null, null, null, null], '
                  ELSE '' END
               || string_agg(row_json, ', ') WITHIN GROUP (ORDER BY seq, part_key, supp_key)
               || ']}' AS content
        FROM answer_row GROUP BY doc_id, page_no""",
    "call_answer": f"""
        SELECT doc_id, 'H' AS call_id, 0 AS page_no, 'first' AS attempt,
               CASE WHEN doc_id % 30 = 0 THEN '<think> dates first </think>' ELSE '' END
               || CASE WHEN doc_id % 45 = 0 THEN '{{"po_no": ' ELSE {_header_json()} END AS content,
               CASE WHEN doc_id % 65 = 0 THEN 'given' END AS reasoning,
               CASE WHEN doc_id % 50 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
               doc_id % 500 AS completion_tokens,
               CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 * 10 END AS reported_reasoning,
               CASE WHEN doc_id % 77 = 0 THEN 'transient' END AS request_error
        FROM po_header
        UNION ALL
        SELECT doc_id, 'LI-p' || CAST(page_no AS STRING), page_no, 'first',
               CASE WHEN doc_id % 55 = 0 THEN '[1, 2]' WHEN doc_id % 85 = 0 THEN '{{"rows": 7}}'
                    ELSE content END,
               CAST(NULL AS STRING), CASE WHEN doc_id % 75 = 0 THEN 'length' ELSE 'stop' END,
               doc_id % 700, CAST(NULL AS BIGINT), CAST(NULL AS STRING)
        FROM line_answer
        UNION ALL
        SELECT doc_id, 'LI-p' || CAST(page_no AS STRING), page_no, 'retry',
               CASE WHEN doc_id % 10 = 0 THEN 'not json' ELSE content END,
               'looked again', 'stop', doc_id % 900, doc_id % 90, CAST(NULL AS STRING)
        FROM line_answer WHERE doc_id % 5 = 0""",
    # Answers of whole orders. First answers carry defects that the retry of their call mends, unless it fails too.
    "order_row": f"""
        SELECT r.doc_id, r.page_no, r.seq, '[' || {_ROW_JSON} || ']' AS good,
               CASE WHEN (r.doc_id * 7 + r.seq) % 101 = 0 THEN '[1, 2, 3]'
                    WHEN r.doc_id % 8 = 2 AND r.seq = 1 THEN '[' || {_ROW_JSON.replace("quantity", "quantity + 1")} || ']'
                    ELSE '[' || {_ROW_JSON} || ']' END AS given
        FROM (SELECT *, line_no AS seq FROM po_line) r""",
    "order_rows": """
        SELECT doc_id, page_no,
               string_agg(good, ', ') WITHIN GROUP (ORDER BY seq) AS good,
               CASE WHEN doc_id % 16 = 4 AND page_no = 2 THEN
                  '[null, null, "with seal kit", null, null, null, null, null, null, null, null, null], ' ELSE '' END
               || string_agg(given, ', ') WITHIN GROUP (ORDER BY seq)
               || CASE WHEN doc_id % 12 = 5 THEN ', ' || max(good) ELSE '' END AS given
        FROM order_row GROUP BY doc_id, page_no""",
    "order_answer": f"""
        SELECT doc_id, 'H' AS call_id, 0 AS page_no, attempt,
               CASE WHEN attempt = 'retry' AND doc_id % 10 = 3 THEN 'not json' WHEN attempt = 'retry' THEN {_whole_header("0")}
                    WHEN doc_id % 45 = 1 THEN '{{"po_no": '
                    ELSE {_whole_header("CASE WHEN doc_id % 6 = 1 THEN 500 ELSE 0 END", True)} END AS content,
               CAST(NULL AS STRING) AS reasoning, CASE WHEN attempt = 'first' AND doc_id % 50 = 2 THEN 'length' ELSE 'stop' END AS finish_reason,
               CASE WHEN attempt = 'first' AND doc_id % 77 = 0 THEN 'transient' END AS request_error
        FROM po_header JOIN (VALUES ('first'), ('retry')) AS a(attempt) ON doc_id IS NOT NULL
        UNION ALL
        SELECT doc_id, 'LI-p' || CAST(page_no AS STRING), page_no, attempt,
               CASE WHEN attempt = 'retry' AND doc_id % 10 = 3 THEN 'not json' WHEN attempt = 'retry' THEN '{{"rows": [' || good || ']}}'
                    WHEN doc_id % 55 = 0 THEN '[1, 2]' WHEN doc_id % 85 = 1 THEN '{{"rows": 7}}' ELSE '{{"rows": [' || given || ']}}' END,
               CAST(NULL AS STRING), CASE WHEN attempt = 'first' AND doc_id % 75 = 4 THEN 'length' ELSE 'stop' END,
               CASE WHEN attempt = 'first' AND doc_id % 91 = 6 AND page_no = 1 THEN 'api' END
        FROM order_rows JOIN (VALUES ('first'), ('retry')) AS a(attempt) ON doc_id IS NOT NULL""",
    # When each call of a document was queued, sent and answered.
    "call_times": """
        SELECT user_id AS doc_id, event_id AS call_id, ts AS queued_at,
               lead(ts, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sent_at,
               lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done_at,
               min(ts) OVER (PARTITION BY user_id) AS doc_start
        FROM events""",
    # Service log. Jobs are users; each event type is a step of the lifecycle.
    "job_events": """
        SELECT user_id AS job_id, event_id, ts, value,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing'
                    WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'needs_review'
                    ELSE 'failed' END AS type
        FROM events""",
    # A well-formed job table over the same log: one job per event.
    "jobs": """
        SELECT event_id AS job_id, ts AS created_at, event_id AS po_seq,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing'
                    WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'needs_review'
                    ELSE 'failed' END AS status,
               CASE WHEN event_type IN ('purchase', 'click', 'error')
                    THEN CAST(value AS DECIMAL(12,2)) END AS latency_ms,
               CASE WHEN event_type <> 'signup' THEN CAST(event_id % 977 AS DECIMAL(12,2)) END AS queue_ms,
               event_id % 5 = 0 AS retried,
               CASE event_id % 4 WHEN 0 THEN 'native native' WHEN 1 THEN 'scanned'
                    WHEN 2 THEN 'native scanned native' END AS page_kinds
        FROM events""",
    "submissions": "SELECT doc_id AS po_seq, text, sha2_text AS job_id FROM ("
    "SELECT doc_id, text, md5(text) AS sha2_text FROM documents) d",
}

_WORD = re.compile(r"\b[a-z_]+\b")
# DuckDB writes an aggregate's order inside its brackets.
_WITHIN = re.compile(r"\) WITHIN GROUP \(ORDER BY ([^)]*)\)")


#: Tables that many queries read: written once for each application and folder. Predictions are a projection of the
#: written headers and lines, which costs less than a copy of both on disk.
STORED = ("po_party", "po_line", "po_header", "page_text", "call_answer", "order_answer")
_PATHS: dict[tuple[str, str, str], str] = {}


def closure(names: list[str], ready: tuple[str, ...] = ()) -> list[str]:
    """The named tables and everything they read, in definition order; `ready` ones read nothing."""
    wanted, todo = set(), [n for n in names if n in TABLES]
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            if n not in ready:
                todo += [w for w in _WORD.findall(TABLES[n]) if w in TABLES and w != n]
    return [n for n in TABLES if n in wanted]


def with_clause(sql: str, extra: dict[str, str] | None = None) -> str:
    """`sql` behind the WITH chain of the bridge tables (and extra views) it names."""
    extra = extra or {}
    body = sql + " " + " ".join(extra.values())
    chain = closure(_WORD.findall(body))
    parts = [f"{n} AS ({TABLES[n]})" for n in chain]
    parts += [f"{n} AS MATERIALIZED ({q})" for n, q in extra.items()]
    out = ("WITH " + ", ".join(parts) + " " if parts else "") + sql
    return _WITHIN.sub(r" ORDER BY \1)", out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge or driver table: a lazy plan over parquet files of the driver and of STORED tables."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in STORED:
        return spark.read.parquet(_stored(spark, sf_dir, name))
    return _planned(spark, sf_dir, name, STORED)


def lazy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a query that reads few of its columns, once: planned over the parties of orders and what is
    written already, so Spark leaves out all other columns, their joins and the window that numbers rows."""
    written = tuple(n for n in STORED if n == "po_party" or (spark.sparkContext.applicationId, sf_dir, n) in _PATHS)
    return table(spark, sf_dir, name) if name in written else _planned(spark, sf_dir, name, written)


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        path = place(spark, f"bridge-{name}")
        # pages print a few header fields: for them alone the whole headers are not written
        inline = {name} | ({"po_header"} if name == "page_text" and (*key[:2], "po_header") not in _PATHS else set())
        write(_planned(spark, sf_dir, name, tuple(n for n in STORED if n not in inline)), path)
        _PATHS[key] = path
    return _PATHS[key]


def _planned(spark: SparkSession, sf_dir: str, name: str, ready: tuple[str, ...]) -> DataFrame:
    chain = closure([name], ready)
    words = {w for n in chain if n not in ready for w in _WORD.findall(TABLES[n])}
    paths = [(b, f"{sf_dir}/{b}.parquet") for b in BASE_TABLES if b in words] + [(n, _stored(spark, sf_dir, n)) for n in chain if n in ready]
    parts = [f"{n} AS (SELECT * FROM parquet.`{path}`)" for n, path in paths] + [f"{n} AS ({TABLES[n]})" for n in chain if n not in ready]
    return spark.sql("WITH " + ", ".join(parts) + f" SELECT * FROM {name}")


assert set(CRITICAL_HEADER_FIELDS) <= set(HEADER_FIELDS)
