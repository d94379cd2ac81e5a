"""Answer ingestion and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog import duck
from poledger.catalog.registry import query
from poledger.operators import ingest
from poledger.plans.staging import settle
from poledger.refdata import CRITICAL_HEADER_FIELDS, SHORT_TO_FULL

_PARSED = r"""
    SELECT *, CASE WHEN request_error IS NOT NULL THEN request_error WHEN finish_reason = 'length' THEN 'truncated'
        WHEN NOT json_valid(answer) OR json_type(answer) <> 'OBJECT' THEN 'invalid_json' END AS error_kind
    FROM (SELECT *, regexp_replace(content, '(?s)^\s*<think>(.*?)</think>', '') AS answer,
                 coalesce(nullif(reasoning, ''), nullif(trim(regexp_extract(content, '(?s)^\s*<think>(.*?)</think>', 1)), '')) AS thought
          FROM call_answer) c"""
_BEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, call_id ORDER BY
        CASE WHEN attempt = 'retry' AND error_kind IS NULL THEN 0 WHEN attempt = 'first' THEN 1 ELSE 2 END) AS rn FROM parsed) x
    WHERE rn = 1"""
_ROWS = """
    SELECT doc_id, call_id, page_no, i - 1 AS idx, r AS cells,
           CASE WHEN json_type(r) = 'ARRAY' THEN json_array_length(r) END AS n
    FROM (SELECT doc_id, call_id, page_no, unnest(json_extract(answer, '$.rows[*]')) AS r,
                 generate_subscripts(json_extract(answer, '$.rows[*]'), 1) AS i
          FROM best WHERE error_kind IS NULL AND call_id <> 'H' AND json_type(answer, '$.rows') = 'ARRAY') x"""


def _cell(i: int) -> str:
    return f"cells->>'$[{i}]'"


_DECODED = f"""
    SELECT doc_id, call_id, page_no, idx, {_cell(0)} AS line_no, {_cell(1)} AS item_code, {_cell(2)} AS description, {_cell(3)} AS hsn_sac,
           {_cell(4)} AS quantity, {_cell(5)} AS uom, {_cell(6)} AS unit_rate, {_cell(7)} AS discount_pct, {_cell(8)} AS taxable_value,
           {_cell(9)} AS gst_rate, {_cell(10)} AS line_total, {_cell(11)} AS line_delivery_date
    FROM row_list WHERE n = 12"""
# Two pages at most in these documents, so the head is the last decoded row of page 1.
_FRAG = "(line_no IS NULL AND quantity IS NULL AND idx = 0)"
_JOINED = f"""
    SELECT d.* REPLACE (CASE WHEN f.doc_id IS NOT NULL AND f.description IS NOT NULL THEN trim(coalesce(d.description, '') || ' ' || f.description)
                             ELSE d.description END AS description,
                        CASE WHEN f.doc_id IS NOT NULL THEN coalesce(d.uom, f.uom) ELSE d.uom END AS uom,
                        CASE WHEN f.doc_id IS NOT NULL THEN coalesce(d.discount_pct, f.discount_pct) ELSE d.discount_pct END AS discount_pct)
    FROM decoded d
    LEFT JOIN (SELECT doc_id, max(idx) AS idx FROM decoded WHERE page_no = 1 AND NOT {_FRAG} GROUP BY doc_id) h
      ON h.doc_id = d.doc_id AND d.page_no = 1 AND h.idx = d.idx
    LEFT JOIN (SELECT * FROM decoded WHERE page_no = 2 AND {_FRAG}) f ON f.doc_id = h.doc_id
    WHERE NOT (d.page_no = 2 AND {_FRAG.replace('line_no', 'd.line_no').replace('quantity', 'd.quantity').replace('idx', 'd.idx')}
               AND d.doc_id IN (SELECT doc_id FROM decoded WHERE page_no = 1 AND NOT {_FRAG}))"""
_FILLED = " + ".join(
    f"({c} IS NOT NULL)::INT"
    for c in ("line_no", "item_code", "description", "hsn_sac", "quantity", "uom", "unit_rate", "discount_pct",
              "taxable_value", "gst_rate", "line_total", "line_delivery_date")
)
_DEDUPED = f"""
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY {_FILLED} DESC,
        length(coalesce(description, '')) DESC, page_no, idx) AS rn FROM joined) x WHERE rn = 1 OR line_no IS NULL"""
PARSED = {"parsed": _PARSED}
BEST = {**PARSED, "best": _BEST}
V = {**BEST, "row_list": _ROWS, "decoded": _DECODED, "joined": _JOINED, "deduped": _DEDUPED}


def parsed(t):
    return ingest.parse_answers(t("call_answer"))


def line_answers(t):
    """The better answer of each line call. Header answers and the tables they are made of are not derived."""
    lines = t.lazy("call_answer").filter("call_id <> 'H'")
    return ingest.best_answer(ingest.parse_answers(lines)).filter("ok").filter(
        F.ltrim(F.get_json_object("answer", "$.rows")).startswith("[")
    )


def rows(t):
    """Written once: joining fragments reads them four times."""
    return ingest.row_parts(settle(ingest.split_rows(line_answers(t)), "rows"))[0]


@query("parse_answers", "SELECT doc_id, call_id, attempt, thought, error_kind FROM parsed", PARSED)
def parse_answers(t):
    return parsed(t).select("doc_id", "call_id", "attempt", "thought", "error_kind")


_SHORT = {f: s for s, f in SHORT_TO_FULL.items()}
_COMPLETE = " AND ".join(f"json_extract_string(answer, '$.{_SHORT[f]}') IS NOT NULL" for f in CRITICAL_HEADER_FIELDS)


@query(
    "parse_baseline",
    f"""SELECT doc_id, CASE WHEN request_error IS NOT NULL THEN 'failed' WHEN CASE WHEN json_valid(answer) THEN {_COMPLETE} ELSE false END
               THEN 'completed' ELSE 'parse_error' END AS status,
               request_error IS NULL AND json_valid(answer) AS kept FROM parsed WHERE call_id = 'H'""",
    PARSED,
)
def parse_baseline(t):
    return ingest.parse_baseline(t("call_answer").filter("call_id = 'H'")).select("doc_id", "status", "kept")


_USABLE = "reported_reasoning IS NOT NULL AND (reported_reasoning > 0 OR thought IS NULL)"


@query(
    "reasoning_tokens",
    f"""SELECT doc_id, call_id, attempt, CASE WHEN {_USABLE} THEN reported_reasoning
               ELSE CAST(round_even(completion_tokens * length(thought) / (length(thought) + length(answer)), 0) AS BIGINT) END AS reasoning_tokens,
               NOT ({_USABLE}) AND thought IS NOT NULL AS estimated FROM parsed""",
    PARSED,
)
def reasoning_tokens(t):
    return ingest.reasoning_tokens(t.lazy("call_answer")).select("doc_id", "call_id", "attempt", "reasoning_tokens", "estimated")


def header_answers(t):
    """The header answers that can be read. Line answers are not derived."""
    return ingest.parse_answers(t.lazy("call_answer").filter("call_id = 'H'")).filter("ok")


_FULL = "CASE key " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in SHORT_TO_FULL.items()) + " END"


@query(
    "rename_keys",
    f"""SELECT doc_id, key, coalesce({_FULL}, key) AS field, ({_FULL}) IS NOT NULL AS known FROM (
          SELECT doc_id, unnest(json_keys(answer)) AS key FROM parsed WHERE error_kind IS NULL AND call_id = 'H') k""",
    PARSED,
)
def rename_keys(t):
    return ingest.rename_keys(header_answers(t)).select("doc_id", "key", "field", "known")


@query(
    "decode_rows",
    "SELECT doc_id, call_id, idx, line_no, item_code, description, uom, line_delivery_date FROM decoded",
    V,
)
def decode_rows(t):
    return rows(t).select("doc_id", "call_id", F.col("idx").cast("bigint").alias("idx"), "line_no", "item_code", "description", "uom", "line_delivery_date")


@query(
    "decode_row_errors",
    """SELECT doc_id, call_id, idx, 'expected 12 cells, got ' || coalesce(CAST(n AS VARCHAR), 'str') AS message
       FROM row_list WHERE coalesce(n, 0) <> 12""",
    V,
)
def decode_row_errors(t):
    return ingest.decode_rows(line_answers(t))[1].select("doc_id", "call_id", F.col("idx").cast("bigint").alias("idx"), "message")


@query(
    "first_bad_row",
    "SELECT doc_id, call_id, min(idx) AS idx FROM row_list WHERE coalesce(n, 0) <> 12 GROUP BY doc_id, call_id",
    V,
)
def first_bad_row(t):
    return ingest.first_bad_row(ingest.decode_rows(line_answers(t))[1]).select("doc_id", "call_id", F.col("idx").cast("bigint").alias("idx"))


@query(
    "merge_header",
    """SELECT doc_id, answer->>'$.po_no' AS po_number, answer->>'$.po_dt' AS po_date, answer->>'$.v_gstin' AS vendor_gstin,
              CAST(CAST(answer->>'$.subtotal' AS DECIMAL(18,2)) AS DOUBLE) AS subtotal,
              coalesce(CAST(CAST(answer->>'$.igst_tot' AS DECIMAL(18,2)) AS DOUBLE), 0) AS igst_total,
              CAST(CAST(answer->>'$.gr_total' AS DECIMAL(18,2)) AS DOUBLE) AS grand_total, answer->>'$.curr' AS currency
       FROM parsed WHERE error_kind IS NULL AND call_id = 'H'""",
    PARSED,
)
def merge_header(t):
    h, _ = ingest.merge_header(header_answers(t))
    return h.select(
        "doc_id", "po_number", F.col("po_date").cast("string").alias("po_date"), "vendor_gstin",
        *[F.col(c).cast("double").alias(c) for c in ("subtotal", "igst_total", "grand_total")], "currency",
    )


@query(
    "merge_header_errors",
    """SELECT doc_id, field, error FROM (
         SELECT doc_id, 'foo' AS field, 'unknown field' AS error FROM parsed WHERE error_kind IS NULL AND call_id = 'H' AND contains(answer, '"foo"')
         UNION ALL SELECT doc_id, 'amendment_date', 'not a date value' FROM parsed WHERE error_kind IS NULL AND call_id = 'H' AND contains(answer, '"amd_dt"')
         UNION ALL SELECT doc_id, 'freight_charges', 'not a money value' FROM parsed WHERE error_kind IS NULL AND call_id = 'H' AND contains(answer, '"freight"')) e""",
    PARSED,
)
def merge_header_errors(t):
    return ingest.merge_header(header_answers(t))[1]


@query("join_fragments", "SELECT doc_id, call_id, idx, line_no, description, uom FROM joined", V)
def join_fragments(t):
    return ingest.join_fragments(rows(t)).select("doc_id", "call_id", F.col("idx").cast("bigint").alias("idx"), "line_no", "description", "uom")


@query("dedupe_rows", "SELECT doc_id, call_id, idx, line_no, description FROM deduped", V)
def dedupe_rows(t):
    return ingest.dedupe_rows(ingest.join_fragments(rows(t))).select("doc_id", "call_id", F.col("idx").cast("bigint").alias("idx"), "line_no", "description")


@query(
    "type_rows",
    """SELECT doc_id, CAST(line_no AS INT) AS line_no, call_id, CAST(CAST(quantity AS DECIMAL(15,3)) AS DOUBLE) AS quantity,
              CAST(CAST(taxable_value AS DECIMAL(18,2)) AS DOUBLE) AS taxable_value, line_delivery_date
       FROM deduped WHERE line_no IS NOT NULL AND description IS NOT NULL AND hsn_sac IS NOT NULL AND quantity IS NOT NULL
         AND unit_rate IS NOT NULL AND taxable_value IS NOT NULL AND gst_rate IS NOT NULL AND line_total IS NOT NULL""",
    V,
)
def type_rows(t):
    good, _ = ingest.type_rows(ingest.dedupe_rows(ingest.join_fragments(rows(t))))
    return good.select(
        "doc_id", "line_no", "call_id", F.col("quantity").cast("double").alias("quantity"),
        F.col("taxable_value").cast("double").alias("taxable_value"), F.col("line_delivery_date").cast("string").alias("line_delivery_date"),
    )


@query(
    "type_row_errors",
    "SELECT doc_id, call_id, 'line_no: Field required' AS message FROM deduped WHERE line_no IS NULL",
    V,
)
def type_row_errors(t):
    return ingest.type_rows(ingest.dedupe_rows(ingest.join_fragments(rows(t))))[1].select("doc_id", "call_id", "message")


@query(
    "missing_calls",
    """SELECT DISTINCT c.doc_id, c.call_id FROM call_answer c WHERE NOT EXISTS (
         SELECT 1 FROM best p WHERE p.doc_id = c.doc_id AND p.call_id = c.call_id AND error_kind IS NULL
           AND (p.call_id = 'H' OR json_type(CASE WHEN json_valid(answer) THEN answer ELSE '{}' END, '$.rows') = 'ARRAY'))""",
    BEST,
)
def missing_calls(t):
    planned = t("call_answer").select("doc_id", "call_id").distinct()
    return ingest.missing_calls(ingest.best_answer(parsed(t)), planned)


@query("best_answer", "SELECT doc_id, call_id, attempt, error_kind FROM best", BEST)
def best_answer(t):
    return ingest.best_answer(parsed(t)).select("doc_id", "call_id", "attempt", "error_kind")


@query(
    "complete_pos",
    f"""SELECT doc_id, {' AND '.join(f'{f} IS NOT NULL' for f in CRITICAL_HEADER_FIELDS)} AS complete,
               concat_ws(',', {', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in sorted(CRITICAL_HEADER_FIELDS))}) AS missing
        FROM po_header""",
)
def complete_pos(t):
    return ingest.complete_pos(t("po_header"))
