"""Scoring, aggregation, ranking, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.catalog import duck
from poledger.catalog.registry import query
from poledger.operators import report, scoring
from poledger.plans import evaluation
from poledger.plans.staging import settle
from poledger.refdata import (
    COMPUTED_HEADER_FIELDS,
    COMPUTED_LINE_COLUMNS,
    CRITICAL_HEADER_FIELDS,
    CRITICAL_LINE_COLUMNS,
    FIELD_TYPE,
    HEADER_FIELDS,
    LINE_COLUMNS,
)

_OUTCOME = """CASE WHEN t IS NULL AND p IS NULL THEN 'correct_absent' WHEN p IS NULL THEN 'missed'
    WHEN t IS NULL THEN 'hallucinated' WHEN t = p THEN 'correct' ELSE 'wrong' END"""


def _scored(inner: str) -> str:
    return f"""SELECT *, {_OUTCOME} AS outcome FROM (
        SELECT *, {duck.normal("ftype", "truth")} AS t, {duck.normal("ftype", "pred")} AS p FROM ({inner}) a) b"""


_HS = _scored(" UNION ALL ".join(
    f"SELECT h.doc_id, '{f}' AS field, '{FIELD_TYPE[f]}' AS ftype, CAST(h.{f} AS VARCHAR) AS truth, CAST(q.{f} AS VARCHAR) AS pred "
    f"FROM po_header h LEFT JOIN pred_header q ON q.doc_id = h.doc_id"
    for f in HEADER_FIELDS
))
_NUMBERED = """
    SELECT t.doc_id, t.line_no AS t_idx, p.idx AS p_idx FROM po_line t
    JOIN (SELECT *, count(*) OVER (PARTITION BY doc_id, line_no) AS k FROM pred_line) p
      ON p.doc_id = t.doc_id AND p.line_no = t.line_no AND k = 1"""
# Rows left over pair by content. In these tables two texts are similar when the words of one hold
# those of the other (similarity 100); pairs go by score, then by place, each row once.
_WORDS = "list_sort(list_distinct(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')))"
_LEFT = f"""
    SELECT t.doc_id, t.line_no AS t_idx, p.idx AS p_idx, (t.item_code = p.item_code)::INT AS code, (t.quantity = p.quantity)::INT AS qty,
           (list_has_all({_WORDS.format("t.description")}, {_WORDS.format("p.description")})
            OR list_has_all({_WORDS.format("p.description")}, {_WORDS.format("t.description")}))::INT AS alike
    FROM po_line t JOIN pred_line p ON p.doc_id = t.doc_id
    WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.doc_id = t.doc_id AND n.t_idx = t.line_no)
      AND NOT EXISTS (SELECT 1 FROM numbered n WHERE n.doc_id = p.doc_id AND n.p_idx = p.idx)"""
_RANKED = """
    SELECT doc_id, t_idx, p_idx, row_number() OVER (PARTITION BY doc_id ORDER BY code + qty + alike DESC, t_idx, p_idx) AS i
    FROM leftover WHERE alike = 1 OR code + qty = 2"""
_MATCH = """
    WITH RECURSIVE taken AS (
        SELECT doc_id, 0::BIGINT AS i, []::INT[] AS ts, []::INT[] AS ps, NULL::INT AS t_idx, NULL::INT AS p_idx FROM (SELECT DISTINCT doc_id FROM ranked)
        UNION ALL SELECT r.doc_id, r.i, CASE WHEN free THEN list_append(ts, r.t_idx::INT) ELSE ts END, CASE WHEN free THEN list_append(ps, r.p_idx::INT) ELSE ps END,
               CASE WHEN free THEN r.t_idx::INT END, CASE WHEN free THEN r.p_idx::INT END
        FROM (SELECT r.*, k.ts, k.ps, NOT list_contains(k.ts, r.t_idx::INT) AND NOT list_contains(k.ps, r.p_idx::INT) AS free
              FROM taken k JOIN ranked r ON r.doc_id = k.doc_id AND r.i = k.i + 1) r)
    SELECT doc_id, t_idx, p_idx FROM numbered UNION ALL SELECT doc_id, t_idx, p_idx FROM taken WHERE t_idx IS NOT NULL"""
_MV = {"numbered": _NUMBERED, "leftover": _LEFT, "ranked": _RANKED, "matches": _MATCH}
_CS = _scored(" UNION ALL ".join(
    f"SELECT m.doc_id, t.line_no AS row, '{c}' AS field, '{FIELD_TYPE[c]}' AS ftype, CAST(t.{c} AS VARCHAR) AS truth, "
    f"CAST(p.{c} AS VARCHAR) AS pred FROM matches m JOIN po_line t ON t.doc_id = m.doc_id AND t.line_no = m.t_idx "
    f"JOIN pred_line p ON p.doc_id = m.doc_id AND p.idx = m.p_idx"
    for c in LINE_COLUMNS
))
_UN = """
    SELECT doc_id, 'missed' AS kind, line_no AS row, description FROM po_line t
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = t.doc_id AND m.t_idx = t.line_no)
    UNION ALL SELECT doc_id, 'hallucinated', line_no, description FROM pred_line p
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = p.doc_id AND m.p_idx = p.idx)"""
_ERR = """
    SELECT doc_id, field, outcome, CAST(NULL AS INT) AS row, truth, pred FROM hs WHERE outcome IN ('wrong','missed','hallucinated')
    UNION ALL SELECT doc_id, 'line_items.' || field, outcome, row, truth, pred FROM cs WHERE outcome IN ('wrong','missed','hallucinated')
    UNION ALL SELECT doc_id, 'line_items', kind, row, CASE WHEN kind = 'missed' THEN description END,
              CASE WHEN kind <> 'missed' THEN description END FROM unmatched"""
_BAD_DOCS = f"""
    SELECT doc_id FROM hs WHERE field IN ({duck.quoted(CRITICAL_HEADER_FIELDS)}) AND outcome NOT IN ('correct','correct_absent')
    UNION SELECT doc_id FROM cs WHERE field IN ({duck.quoted(CRITICAL_LINE_COLUMNS)}) AND outcome NOT IN ('correct','correct_absent')
    UNION SELECT doc_id FROM unmatched WHERE kind = 'missed'"""
V = {"hs": _HS, **_MV, "cs": _CS, "unmatched": _UN, "errs": _ERR, "bad_docs": _BAD_DOCS}
_HV = {"hs": _HS}
_CV = {**_MV, "cs": _CS}
_UV = {**_MV, "unmatched": _UN}


def truth_rows(t):
    return t("po_line").withColumn("idx", F.col("line_no"))


_MATCHES: dict[tuple[str, str], DataFrame] = {}


def matches(t) -> DataFrame:
    """The run's matched rows, found once for each application and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _MATCHES:
        _MATCHES[key] = evaluation.row_matches(truth_rows(t), t("pred_line"))
    return _MATCHES[key]


def run(t, **kw):
    return evaluation.score(t("po_header"), truth_rows(t), t("pred_header"), t("pred_line"), matches=matches(t), **kw)


def oracle(t):
    """The oracle run: the truth as its own prediction."""
    return evaluation.score(t("po_header"), truth_rows(t), t("po_header"), truth_rows(t))


@query(
    "scored_fields",
    f"""SELECT field, count(*) AS n FROM hs WHERE field NOT IN ({duck.quoted(COMPUTED_HEADER_FIELDS)}) GROUP BY field
        UNION ALL SELECT 'line_items.' || field, count(*) FROM cs WHERE field NOT IN ({duck.quoted(COMPUTED_LINE_COLUMNS)}) GROUP BY field""",
    {**_HV, **_CV},
)
def scored_fields(t):
    s = run(t, include_computed=False)
    n = F.count("*").alias("n")
    cells = s.cells.groupBy("field").agg(n).withColumn("field", F.concat(F.lit("line_items."), "field"))
    return s.header.groupBy("field").agg(n).unionByName(cells)


@query("score_header", "SELECT doc_id, field, outcome, t, p FROM hs", _HV)
def score_header(t):
    return scoring.score_header(t("po_header"), t("pred_header")).select("doc_id", "field", "outcome", "t", "p")


@query("fuzzy_text")
def fuzzy_text(t):
    h = scoring.with_fuzzy(scoring.score_header(t("po_header"), t("pred_header")))
    return h.filter("fuzzy is not null").select("doc_id", "field", "t", "p", F.round("fuzzy", 6).alias("fuzzy"))


@query("match_line_no", "SELECT doc_id, t_idx, p_idx FROM numbered", _UV)
def match_line_no(t):
    return scoring.match_by_number(truth_rows(t), t("pred_line"))


@query(
    "match_content",
    "SELECT doc_id, t_idx, p_idx FROM matches m WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.doc_id = m.doc_id AND n.t_idx = m.t_idx)",
    _MV,
)
def match_content(t):
    return matches(t).filter("not by_line_no").select("doc_id", "t_idx", "p_idx")


@query("score_cells", 'SELECT doc_id, "row", field, outcome FROM cs', _CV)
def score_cells(t):
    return run(t).cells.select("doc_id", "row", "field", "outcome")


@query("missed_extra_rows", 'SELECT doc_id, kind, "row", description FROM unmatched', _UV)
def missed_extra_rows(t):
    return run(t).rows


@query(
    "critical_docs",
    """SELECT h.doc_id, b.doc_id IS NULL AS critical_correct FROM po_header h LEFT JOIN bad_docs b ON b.doc_id = h.doc_id""",
    V,
)
def critical_docs(t):
    return run(t).docs.select("doc_id", "critical_correct")


@query("error_list", 'SELECT doc_id, field, outcome, "row", truth, pred FROM errs', V)
def error_list(t):
    return run(t).error_list()


_FIELD_TALLY = """
    SELECT field, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'wrong') AS wrong,
        count(*) FILTER (WHERE outcome = 'missed') AS missed, count(*) FILTER (WHERE outcome = 'hallucinated') AS hallucinated,
        count(*) FILTER (WHERE outcome = 'correct_absent') AS correct_absent, count(*) AS total,
        CAST(count(*) FILTER (WHERE outcome IN ('correct','correct_absent')) AS DOUBLE) / count(*) AS accuracy,
        CAST(count(*) FILTER (WHERE ftype = 'text' AND outcome IN ('correct','correct_absent')) AS DOUBLE)
            / nullif(count(*) FILTER (WHERE ftype = 'text'), 0) AS text_exact_accuracy
    FROM ({0}) x GROUP BY field"""


@query("tally", _FIELD_TALLY.format("SELECT 'header' AS field, ftype, outcome FROM hs UNION ALL SELECT 'cells', ftype, outcome FROM cs"), V)
def tally(t):
    return run(t).tally()


@query("field_tally", _FIELD_TALLY.format("SELECT field, ftype, outcome FROM hs UNION ALL SELECT 'line_items.' || field, ftype, outcome FROM cs"), V)
def field_tally(t):
    s = run(t)
    cols = ["field", "ftype", "outcome"]
    cells = s.cells.withColumn("field", F.concat(F.lit("line_items."), "field"))
    return scoring.field_tally(s.header.select(cols).unionByName(cells.select(cols)))


@query("field_tally_fuzzy")
def field_tally_fuzzy(t):
    return scoring.field_tally(scoring.with_fuzzy(scoring.score_header(t("po_header"), t("pred_header"))))


_DOCS = """
    SELECT r.doc_id AS run_doc, r.variant, r.status, m.layout,
           CASE WHEN m.issuer_frequent = 'True' THEN 'frequent' ELSE 'one_off' END AS issuer_type,
           h.ok AS h_ok, h.n AS h_n, coalesce(c.ok, 0) AS c_ok, coalesce(c.n, 0) AS c_n, b.doc_id IS NULL AS good,
           coalesce(tr.n, 0) AS truth_rows, coalesce(pr.n, 0) AS pred_rows, coalesce(mr.n, 0) AS matched
    FROM {records} r JOIN manifest m ON m.id = r.doc_id
    JOIN (SELECT doc_id, count(*) FILTER (WHERE outcome LIKE 'correct%') AS ok, count(*) AS n FROM hs GROUP BY doc_id) h ON h.doc_id = m.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE outcome LIKE 'correct%') AS ok, count(*) AS n FROM cs GROUP BY doc_id) c ON c.doc_id = m.doc_id
    LEFT JOIN bad_docs b ON b.doc_id = m.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM po_line GROUP BY doc_id) tr ON tr.doc_id = m.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM pred_line GROUP BY doc_id) pr ON pr.doc_id = m.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM matches GROUP BY doc_id) mr ON mr.doc_id = m.doc_id"""
_SUMMARY = """
    SELECT CASE WHEN grouping(variant) = 0 THEN 'variant' WHEN grouping(layout) = 0 THEN 'layout'
                WHEN grouping(issuer_type) = 0 THEN 'issuer_type' ELSE 'overall' END AS group_kind,
        coalesce(variant, layout, issuer_type, 'all') AS group_value, count(*) AS docs,
        count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
        count(*) FILTER (WHERE status = 'parse_error') AS parse_error, count(*) FILTER (WHERE status = 'failed') AS failed,
        CAST(count(*) FILTER (WHERE good) AS DOUBLE) / count(*) AS critical_doc_accuracy,
        CAST(sum(h_ok) + sum(c_ok) AS DOUBLE) / CAST(sum(h_n) + sum(c_n) AS DOUBLE) AS field_accuracy,
        CAST(sum(h_ok) AS DOUBLE) / CAST(sum(h_n) AS DOUBLE) AS header_accuracy,
        CAST(sum(c_ok) AS DOUBLE) / nullif(CAST(sum(c_n) AS DOUBLE), 0) AS cell_accuracy,
        CAST(sum(matched) AS DOUBLE) / nullif(CAST(sum(truth_rows) AS DOUBLE), 0) AS row_recall,
        CAST(sum(matched) AS DOUBLE) / nullif(CAST(sum(pred_rows) AS DOUBLE), 0) AS row_precision
    FROM docs GROUP BY GROUPING SETS ((), (variant), (layout), (issuer_type))"""
_SUMMARY_F1 = "SELECT *, 2 * row_recall * row_precision / nullif(row_recall + row_precision, 0) AS row_f1 FROM summary"
SV = {**V, "docs": _DOCS.format(records="records"), "summary": _SUMMARY}


def summary(t):
    return scoring.group_summary(evaluation.with_groups(run(t).docs, t("records"), t("manifest")))


@query("group_summary", _SUMMARY_F1, SV)
def group_summary(t):
    return summary(t)


_LAT = """
    SELECT coalesce(variant, 'all') AS variant, count(*) AS docs,
        round(quantile_cont(CAST(total_ms AS DOUBLE), 0.5), 6) AS p50_ms, round(quantile_cont(CAST(total_ms AS DOUBLE), 0.95), 6) AS p95_ms,
        CAST(max(total_ms) AS DOUBLE) AS max_ms, avg(prompt_tokens) AS mean_prompt, avg(completion_tokens) AS mean_completion,
        avg(reasoning_tokens) AS mean_reasoning, bool_or(reasoning_estimated) AS estimated, avg(calls) AS mean_calls,
        count(*) FILTER (WHERE status = 'parse_error') AS parse_errors
    FROM records GROUP BY GROUPING SETS ((), (variant))"""


@query("latency_summary", _LAT)
def latency_summary(t):
    return scoring.latency_summary(t("records"))


@query("score_run", _SUMMARY_F1, SV)
def score_run(t):
    """Everything with full row matching: the group summary of the whole run."""
    return scoring.group_summary(evaluation.with_groups(run(t).docs, t("records"), t("manifest")))


_FREQ = """SELECT e.*, n FROM errs e JOIN (SELECT field, count(*) AS n FROM errs GROUP BY field) c ON c.field = e.field"""


@query("errors_by_frequency", f"SELECT * FROM ({_FREQ}) x", V)
def errors_by_frequency(t):
    return scoring.by_frequency(run(t).errors)


@query(
    "errors_csv",
    """SELECT id AS doc_id, variant, field, outcome, coalesce(CAST("row" AS VARCHAR), '') AS "row",
              coalesce(truth, '') AS truth, coalesce(pred, '') AS pred FROM errs e JOIN manifest m ON m.doc_id = e.doc_id""",
    V,
)
def errors_csv(t):
    """The error file of all run documents, written as CSV and read back."""
    from poledger.plans.staging import place
    from poledger.sources import runs

    documents = t("manifest").select("doc_id", F.col("id").alias("run_doc"), "variant")
    path = place(t.spark, "errors-csv")
    runs.write_errors(run(t).errors.join(documents, "doc_id"), path, compression="gzip")
    return runs.read_errors(t.spark, path).drop("fuzzy")


@query(
    "top_problem_fields",
    """SELECT field, count(*) AS errors, count(*) FILTER (WHERE outcome = 'wrong') AS wrong,
              count(*) FILTER (WHERE outcome = 'missed') AS missed, count(*) FILTER (WHERE outcome = 'hallucinated') AS hallucinated
       FROM errs GROUP BY field ORDER BY errors DESC, field LIMIT 10""",
    V,
)
def top_problem_fields(t):
    return scoring.top_fields(run(t).errors)


@query(
    "problem_field_examples",
    """SELECT field, rank, doc_id, "row", outcome, truth, pred FROM (
         SELECT *, row_number() OVER (PARTITION BY field ORDER BY in_doc > 1, doc_id, coalesce("row", 0), outcome) AS rank FROM (
           SELECT e.*, row_number() OVER (PARTITION BY e.field, doc_id ORDER BY coalesce("row", 0), outcome) AS in_doc
           FROM errs e JOIN (SELECT field FROM errs GROUP BY field ORDER BY count(*) DESC, field LIMIT 10) f ON f.field = e.field) x
         WHERE in_doc <= 2) y WHERE rank <= 2""",
    V,
)
def problem_field_examples(t):
    errs = run(t).errors
    return scoring.field_examples(errs, scoring.top_fields(errs))


@query(
    "targets_met",
    """SELECT metric, value, CAST(target AS DOUBLE) AS target, coalesce(value >= target, false) AS met FROM (
         SELECT unnest(['field_accuracy', 'critical_doc_accuracy', 'row_recall']) AS metric,
                unnest([field_accuracy, critical_doc_accuracy, row_recall]) AS value, unnest([0.97, 0.98, 0.995]) AS target
         FROM summary WHERE group_kind = 'overall') x""",
    SV,
)
def targets_met(t):
    return scoring.targets_met(summary(t))


@query(
    "oracle_run_score",
    """SELECT 'overall' AS group_kind, count(*) AS docs, CAST(1 AS DOUBLE) AS field_accuracy, CAST(1 AS DOUBLE) AS critical_doc_accuracy,
              CAST(1 AS DOUBLE) AS row_recall FROM manifest""",
)
def oracle_run_score(t):
    records = evaluation.oracle_run(t("manifest"))
    s = scoring.group_summary(evaluation.with_groups(oracle(t).docs, records, t("manifest")))
    return s.filter("group_kind = 'overall'").select(
        "group_kind", "docs", "field_accuracy", "critical_doc_accuracy", "row_recall"
    )


# --- comparison: the oracle run as reference, the predicted run as candidate
@query(
    "compare_runs",
    """SELECT count(*) FILTER (WHERE o.id IS NOT NULL AND r.doc_id IS NOT NULL) AS common,
              count(*) FILTER (WHERE r.doc_id IS NULL) AS ref_only, count(*) FILTER (WHERE o.id IS NULL) AS cand_only
       FROM (SELECT id FROM manifest WHERE split = 'test') o FULL JOIN (SELECT doc_id FROM records WHERE variant <> 'M') r ON r.doc_id = o.id""",
)
def compare_runs(t):
    ref = evaluation.oracle_run(t("manifest").filter("split = 'test'"))
    _, _, counts = evaluation.common_records(ref, t("records").filter("variant <> 'M'"))
    return counts


def _sides(t):
    ref_records, cand_records, _ = evaluation.common_records(evaluation.oracle_run(t("manifest")), t("records"))
    ref = scoring.group_summary(evaluation.with_groups(oracle(t).docs, ref_records, t("manifest")))
    cand = scoring.group_summary(evaluation.with_groups(run(t).docs, cand_records, t("manifest")))
    return (ref, scoring.latency_summary(ref_records)), (cand, scoring.latency_summary(cand_records))


@query(
    "metric_deltas",
    """SELECT metric, round(ref, 6) AS ref, round(cand, 6) AS cand, round(cand - ref, 6) AS delta FROM (
         SELECT unnest(['Critical-doc accuracy', 'Field accuracy', 'Header accuracy', 'Cell accuracy', 'Row recall', 'Row precision']) AS metric,
                CAST(1 AS DOUBLE) AS ref, unnest([critical_doc_accuracy, field_accuracy, header_accuracy, cell_accuracy, row_recall, row_precision]) AS cand
         FROM summary WHERE group_kind = 'overall'
         UNION ALL
         SELECT unnest(['Latency p50', 'Latency p95', 'Mean completion tokens', 'Parse errors']), CAST(0 AS DOUBLE),
                unnest([p50_ms, p95_ms, mean_completion, CAST(parse_errors AS DOUBLE)]) FROM lat WHERE variant = 'all'
         UNION ALL
         SELECT group_value || ': ' || unnest(['critical-doc accuracy', 'field accuracy']), CAST(1 AS DOUBLE),
                unnest([critical_doc_accuracy, field_accuracy]) FROM summary WHERE group_kind = 'variant') x""",
    {**SV, "lat": _LAT},
)
def metric_deltas(t):
    return scoring.metric_deltas(*_sides(t))


@query(
    "acceptance",
    """SELECT CASE WHEN c <= 0.5 + 1e-9 AND f <= 1 + 1e-9 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict,
              round(c, 6) AS critical_drop_pp, round(f, 6) AS field_drop_pp
       FROM (SELECT (1 - critical_doc_accuracy) * 100 AS c, (1 - field_accuracy) * 100 AS f FROM summary WHERE group_kind = 'overall') x""",
    SV,
)
def acceptance(t):
    (ref, _), (cand, _) = _sides(t)
    return scoring.acceptance(ref, cand).drop("limits")


@query(
    "run_summary",
    """SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
              count(*) FILTER (WHERE status = 'failed') AS failed, count(retried_call) AS retried,
              round(quantile_cont(CAST(total_ms AS DOUBLE), 0.5), 6) AS p50_ms, round(quantile_cont(CAST(total_ms AS DOUBLE), 0.95), 6) AS p95_ms,
              avg(completion_tokens) AS mean_completion, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning FROM records""",
)
def run_summary(t):
    return scoring.run_summary(t("records"))


@query("report_json")
def report_json(t):
    """All numbers of the report: by group with tallies of each field, latency, targets, problem fields with examples, errors."""
    s = run(t)
    numbers = settle(scoring.group_summary(evaluation.with_groups(s.docs, t("records"), t("manifest")), rows=report.ROWS), "summary")
    groups = settle(report.groups_of(evaluation.groups(t("records"), t("manifest"))), "groups")
    head, line = scoring.scored()
    tallies = [settle(report.field_tallies(df, names, prefix, groups), "tallies") for df, names, prefix in ((s.unlike_header, head, ""), (s.unlike_cells, line, "line_items."))]
    top = settle(scoring.top_fields(s.errors), "top-fields")
    return report.report(numbers, *tallies, scoring.latency_summary(t("records")), top, scoring.field_examples(s.errors, top), s.errors)
