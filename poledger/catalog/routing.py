"""Routing, request preparation, retries, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog.chain import FIELD_VIEWS, ROUND1_VIEWS, ROUND2_VIEWS, outcome, planned, plans
from poledger.catalog.pages import ROW_VIEWS, features
from poledger.catalog.pages import V as PAGE_VIEWS
from poledger.catalog.registry import query
from poledger.catalog.rules import TAX_VIEWS
from poledger.operators import pages, routing, rules
from poledger.plans import chain
from poledger.plans.staging import settle
from poledger.plans.validation import merged_from

_PLAN = """
    SELECT doc_id, CASE WHEN est > 40 OR ip > 2 THEN 'per_page' ELSE 'two_call' END AS strategy, est AS estimated_rows, ip AS item_pages,
        CASE WHEN est > 40 OR ip > 2 THEN 'per_page' ELSE 'two_call' END || ': rows ' || CASE WHEN wt > 0 THEN CAST(est AS VARCHAR) ELSE '?' END || ' of 40'
            || CASE WHEN nt > 0 AND wt > 0 THEN ' and ' || nt || ' pages unread' ELSE '' END || ', item pages ' || ip || ' of 2' AS reason
    FROM (SELECT r.doc_id, CAST(coalesce(sum(rows), 0) AS BIGINT) AS est, count(rows) AS wt, count(*) - count(rows) AS nt, any_value(ip) AS ip
          FROM page_rows r LEFT JOIN (SELECT doc_id, count(*) AS ip FROM item_pages GROUP BY doc_id) i ON i.doc_id = r.doc_id
          GROUP BY r.doc_id) x"""
PLAN_VIEWS = {**ROW_VIEWS, "plans": _PLAN}


def _rows(t):
    return settle(pages.page_rows(features(t)), "page-rows")  # read by the plan and the item pages


@query("routing_plan", "SELECT doc_id, strategy, estimated_rows, item_pages, reason FROM plans", PLAN_VIEWS)
def routing_plan(t):
    r = _rows(t)
    return routing.plan(r, pages.item_pages(r))


@query(
    "planned_calls",
    """SELECT doc_id, CAST(0 AS INT) AS seq, 'H' AS call_id, 2000 AS max_tokens FROM plans
       UNION ALL SELECT doc_id, 1, 'LI', 6000 FROM plans WHERE strategy = 'two_call'
       UNION ALL SELECT i.doc_id, CAST(page_no AS INT), 'LI-p' || page_no, 6000 FROM item_pages i JOIN plans p ON p.doc_id = i.doc_id
         WHERE strategy = 'per_page'""",
    PLAN_VIEWS,
)
def planned_calls(t):
    r = _rows(t)
    items = pages.item_pages(r)
    return routing.planned_calls(routing.plan(r, items), items).select("doc_id", "seq", "call_id", "max_tokens")


@query(
    "request_prefix_hash",
    """SELECT doc_id, page_no, sha256('Page ' || page_no || ' of ' || n || ' (' || kind || ')' || CASE WHEN layer <> '' THEN
          chr(10) || '--- TEXT LAYER, page ' || page_no || ' (exact characters printed on the page) ---' || chr(10) || layer || chr(10)
          || '--- END TEXT LAYER, page ' || page_no || ' ---' ELSE '' END) AS part_hash
       FROM (SELECT l.*, n FROM layers l JOIN (SELECT doc_id, count(*) AS n FROM layers GROUP BY doc_id) c ON c.doc_id = l.doc_id) x WHERE kept""",
    PAGE_VIEWS,
)
def request_prefix_hash(t):
    counts = t("page_text").groupBy("doc_id").agg(F.count("*").alias("pages"))
    return routing.request_prefix(features(t), counts).select("doc_id", "page_no", "part_hash")


# --- the two rounds: verdicts of all eleven rules over the merged answers choose what runs again
@query("calls_to_retry", "SELECT doc_id, CAST(seq AS INT) AS seq, call_id, alias, max_tokens FROM wanted", ROUND1_VIEWS)
def calls_to_retry(t):
    return routing.calls_to_retry(outcome(t).first.checks, planned(t))


@query("retry_gate", "SELECT doc_id, retry, skipped FROM gate", ROUND1_VIEWS)
def retry_gate(t):
    return outcome(t).gate.withColumn("skipped", F.regexp_replace("skipped", r"^(retry deadline): .*", "$1"))


@query("round_checks", "SELECT doc_id, 1 AS round, rule, passed, retry_target FROM r1_checks UNION ALL SELECT doc_id, 2, rule, passed, retry_target FROM r2_checks", ROUND2_VIEWS)
def round_checks(t):
    """Verdicts of both rounds, a row per document, round and rule."""
    out = outcome(t)
    cols = ("doc_id", "round", "rule", "passed", "retry_target")
    rounds = [r.checks.withColumn("round", F.lit(r.number)).select(*cols) for r in (out.first, out.second)]
    return rounds[0].unionByName(rounds[1])


@query("merged_lines", """
    SELECT doc_id, line_no, call_id, CAST(quantity AS DOUBLE) AS quantity, CAST(line_total AS DOUBLE) AS line_total FROM r2_po_line
    UNION ALL SELECT doc_id, line_no, call_id, CAST(quantity AS DOUBLE), CAST(line_total AS DOUBLE) FROM r1_po_line
    WHERE doc_id NOT IN (SELECT doc_id FROM r2_docs)""", ROUND2_VIEWS)
def merged_lines(t):
    """Line items of the merged orders after the last round."""
    lines = chain.last_lines(outcome(t))
    return lines.select("doc_id", "line_no", "call_id", *[F.col(c).cast("double").alias(c) for c in ("quantity", "line_total")])


@query(
    "final_status",
    """SELECT doc_id, CASE WHEN passed THEN 'completed' ELSE 'needs_review' END AS status FROM verdict
       UNION ALL SELECT doc_id, 'failed' FROM broken""",
    ROUND2_VIEWS,
)
def final_status(t):
    return outcome(t).status


@query(
    "review_queue",
    """SELECT v.doc_id, failed_rules, coalesce(n, 0) AS failed_fields FROM verdict v
       LEFT JOIN (SELECT doc_id, count(DISTINCT field) AS n FROM last_failed GROUP BY doc_id) f ON f.doc_id = v.doc_id WHERE NOT passed""",
    FIELD_VIEWS,
)
def review_queue(t):
    """Failed rules and how many distinct fields they point at, of all eleven rules; the names are rows (chain.failed_fields)."""
    return chain.review(outcome(t))


@query(
    "review_fields",
    """SELECT DISTINCT doc_id, field FROM (
         SELECT doc_id, unnest(['line_items[' || line_no || '].taxable_value', 'line_items[' || line_no || '].quantity',
                                'line_items[' || line_no || '].unit_rate']) AS field
         FROM taxed WHERE abs(taxable_value - CAST(round(CAST(quantity * unit_rate * (100 - coalesce(discount_pct, CAST(0 AS DECIMAL(5,2)))) AS DECIMAL(28,7))
              * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))) > 1
         UNION ALL
         SELECT doc_id, unnest(['line_items[' || line_no || '].line_total', 'line_items[' || line_no || '].gst_rate'])
         FROM taxed WHERE supply IS NOT NULL AND abs(line_total - taxable_value - (coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0))) > 1
         UNION ALL SELECT m.doc_id, 'line_items[' || n || ']' FROM missing_no m
         UNION ALL SELECT doc_id, 'line_items' FROM po_header WHERE doc_id NOT IN (SELECT doc_id FROM po_line)) x""",
    {**TAX_VIEWS, **__import__("poledger.catalog.rules", fromlist=["GAP_VIEWS"]).GAP_VIEWS},
)
def review_fields(t):
    f = rules.check_fields(merged_from(t), ("line_arithmetic", "continuity"))
    return f.select("doc_id", "field").distinct()


_MS = "CAST(round(CAST(epoch_us({b}) - epoch_us({a}) AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)), 1) AS DOUBLE)"


@query(
    "call_timeline",
    f"""SELECT doc_id, call_id, {_MS.format(a='queued_at', b='sent_at')} AS wait_ms, {_MS.format(a='doc_start', b='sent_at')} AS start_ms,
               {_MS.format(a='doc_start', b='done_at')} AS end_ms,
               max({_MS.format(a='doc_start', b='done_at')}) OVER (PARTITION BY doc_id) AS total_ms FROM call_times""",
)
def call_timeline(t):
    c = t("call_times")
    stamps = {x: F.col(x).cast("timestamp") for x in ("queued_at", "sent_at", "done_at", "doc_start")}
    return routing.call_timeline(c.withColumns(stamps))


@query(
    "envelope",
    """SELECT v.doc_id, v.status, error, CAST(h.grand_total AS DOUBLE) AS grand_total, h.po_number, passed, failed_rules,
              strategy, estimated_rows, item_pages, coalesce(calls, '') AS retried_calls, skipped AS retry_skipped, line_count, answers
       FROM (SELECT doc_id, CASE WHEN passed THEN 'completed' ELSE 'needs_review' END AS status, passed, failed_rules FROM verdict
             UNION ALL SELECT doc_id, 'failed', NULL, NULL FROM broken) v
       LEFT JOIN broken b ON b.doc_id = v.doc_id
       LEFT JOIN (SELECT doc_id, po_number, grand_total FROM r2_po_header UNION ALL SELECT doc_id, po_number, grand_total FROM r1_po_header
                  WHERE doc_id NOT IN (SELECT doc_id FROM r2_docs)) h ON h.doc_id = v.doc_id
       LEFT JOIN plans p ON p.doc_id = v.doc_id
       LEFT JOIN (SELECT doc_id, string_agg(call_id, ',' ORDER BY seq) AS calls FROM retried GROUP BY doc_id) r ON r.doc_id = v.doc_id
       LEFT JOIN gate g ON g.doc_id = v.doc_id
       LEFT JOIN (SELECT doc_id, count(*) AS line_count FROM (SELECT doc_id FROM r2_po_line UNION ALL SELECT doc_id FROM r1_po_line
                  WHERE doc_id NOT IN (SELECT doc_id FROM r2_docs)) l GROUP BY doc_id) l ON l.doc_id = v.doc_id
       LEFT JOIN (SELECT doc_id, count(*) FILTER (error_kind IS NULL) AS answers FROM every GROUP BY doc_id) a ON a.doc_id = v.doc_id""",
    {**PLAN_VIEWS, **ROUND2_VIEWS},
)
def envelope(t):
    """One nested row per document, its parts compared by what they hold."""
    e = chain.envelopes(outcome(t), plans(t))
    return e.select(
        "doc_id", "status", "error", F.col("data.grand_total").cast("double").alias("grand_total"), "data.po_number", "validation.passed",
        "review.failed_rules", "routing.strategy", "routing.estimated_rows", "routing.item_pages", F.coalesce("routing.retried_calls", F.lit("")).alias("retried_calls"),
        F.regexp_replace("routing.retry_skipped", r"^(retry deadline): .*", "$1").alias("retry_skipped"), "line_count", "answers",
    )


@query(
    "review_items",
    """SELECT doc_id, rule, field FROM (
         SELECT DISTINCT doc_id, 'duplicate_po' AS rule, 'po_number' AS field FROM last_checks WHERE rule = 'duplicate_po' AND NOT passed
         UNION ALL SELECT DISTINCT doc_id, 'continuity', 'line_items[' || n || ']' FROM (SELECT * FROM r2_missing_no UNION ALL SELECT * FROM r1_missing_no
           WHERE doc_id NOT IN (SELECT doc_id FROM r2_docs)) m
         UNION ALL SELECT doc_id, 'continuity', 'line_items' FROM r2_po_header WHERE doc_id NOT IN (SELECT doc_id FROM r2_po_line)
         UNION ALL SELECT doc_id, 'continuity', 'line_items' FROM r1_po_header WHERE doc_id NOT IN (SELECT doc_id FROM r1_po_line)
           AND doc_id NOT IN (SELECT doc_id FROM r2_docs)) x""",
    ROUND2_VIEWS,
)
def review_items(t):
    """Fields to look at after the last round; two rules have SQL, tests cover the others."""
    return chain.failed_fields(outcome(t)).filter(F.col("rule").isin("duplicate_po", "continuity"))


@query("envelope_lines", "SELECT doc_id, line_no, call_id FROM po_line")
def envelope_lines(t):
    """Line items stay rows beside the envelope, so no document's lines are gathered."""
    return t("po_line").select("doc_id", "line_no", "call_id")


# --- projections over the manifest and the lines
@query(
    "doc_variant",
    """SELECT id, CASE WHEN id LIKE '%\\_S' ESCAPE '\\' OR id LIKE '%\\_M' ESCAPE '\\' THEN left(id, length(id) - 2) ELSE id END AS base,
              CASE WHEN id LIKE '%\\_S' ESCAPE '\\' THEN 'S' WHEN id LIKE '%\\_M' ESCAPE '\\' THEN 'M' ELSE 'N' END AS variant FROM manifest""",
)
def doc_variant(t):
    tail = F.regexp_extract("id", r"(?s)\A(.*)_([SM])\z", 2)
    return t("manifest").select(
        "id", F.when(tail != "", F.regexp_extract("id", r"(?s)\A(.*)_([SM])\z", 1)).otherwise(F.col("id")).alias("base"),
        F.when(tail != "", tail).otherwise("N").alias("variant"),
    )


@query(
    "select_docs",
    """SELECT id, variant FROM manifest WHERE base_id IN (SELECT base_id FROM manifest GROUP BY base_id ORDER BY min(doc_id) LIMIT 25)""",
)
def select_docs(t):
    return routing.select_docs(t("manifest"), 25).select("id", "variant")


@query(
    "column_presence",
    """SELECT doc_id, bool_or(item_code IS NOT NULL) AS item_code, bool_or(uom IS NOT NULL) AS uom, bool_or(discount_pct IS NOT NULL) AS discount,
              bool_or(line_delivery_date IS NOT NULL) AS delivery_date, bool_or(cgst_amount IS NOT NULL) AS intra_state FROM po_line GROUP BY doc_id""",
)
def column_presence(t):
    used = {"item_code": "item_code", "uom": "uom", "discount": "discount_pct", "delivery_date": "line_delivery_date", "intra_state": "cgst_amount"}
    return t("po_line").groupBy("doc_id").agg(*[F.bool_or(F.col(c).isNotNull()).alias(n) for n, c in used.items()])
