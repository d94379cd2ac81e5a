"""Service tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog.registry import query
from poledger.operators import service
from poledger.refdata import JOB_STATUSES


@query(
    "submit_dedupe",
    """SELECT sha256(text) AS job_id, doc_id AS po_seq, doc_id = min(doc_id) OVER (PARTITION BY text) AS created FROM documents""",
)
def submit_dedupe(t):
    return service.submit(t("documents").select("text", F.col("doc_id").alias("po_seq")))


# The fold in closed form: nothing counts before the first queued event, and the first event that
# may end the job does.
_EV = "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM job_events"
_BORN = "SELECT job_id, min(i) AS i0, min_by(ts, i) AS created FROM ev WHERE type = 'queued' GROUP BY job_id"
_RUN = "SELECT e.job_id, min(e.i) AS i1, min_by(e.ts, e.i) AS started FROM ev e JOIN born b ON b.job_id = e.job_id WHERE type = 'processing' AND e.i > i0 GROUP BY e.job_id"
_END = """
    SELECT e.job_id, min(e.i) AS i2, min_by(e.ts, e.i) AS ended, min_by(e.type, e.i) AS type FROM ev e
    JOIN born b ON b.job_id = e.job_id LEFT JOIN run r ON r.job_id = e.job_id
    WHERE e.i > i0 AND (e.type = 'failed' OR (e.type IN ('completed', 'needs_review') AND e.i > i1)) GROUP BY e.job_id"""


@query(
    "job_state",
    """SELECT job_id, CASE WHEN i0 IS NULL THEN NULL WHEN i2 IS NOT NULL THEN etype WHEN i1 IS NOT NULL THEN 'processing' ELSE 'queued' END AS status,
              CAST(attempts AS INT) AS attempts, CASE WHEN attempts > 0 THEN (epoch_us(started) - epoch_us(created)) / 1000 END AS queue_ms,
              (epoch_us(ended) - epoch_us(created)) / 1000 AS latency_ms, CAST(others - attempts - CASE WHEN i2 IS NULL THEN 0 ELSE 1 END AS INT) AS wrong
       FROM (SELECT j.job_id, i0, i1, i2, created, started, ended, e.type AS etype,
                count(*) FILTER (WHERE v.type <> 'queued') AS others,
                count(*) FILTER (WHERE v.type = 'processing' AND v.i > i0 AND v.i < coalesce(i2, 1000000000)) AS attempts
             FROM (SELECT DISTINCT job_id FROM ev) j LEFT JOIN born b ON b.job_id = j.job_id LEFT JOIN run r ON r.job_id = j.job_id
             LEFT JOIN fin e ON e.job_id = j.job_id JOIN ev v ON v.job_id = j.job_id
             GROUP BY j.job_id, i0, i1, i2, created, started, ended, e.type) x""",
    {"ev": _EV, "born": _BORN, "run": _RUN, "fin": _END},
)
def job_state(t):
    return service.job_state(t("job_events"))


@query(
    "list_jobs",
    """SELECT job_id, status FROM jobs WHERE status = 'completed' AND created_at >= TIMESTAMP '2024-01-10 00:00:00'
       ORDER BY created_at DESC, po_seq DESC LIMIT 100""",
)
def list_jobs(t):
    return service.list_jobs(t("jobs"), "completed", "2024-01-10 00:00:00").select("job_id", "status")


@query(
    "job_with_result",
    """SELECT j.job_id, j.status, r.props FROM jobs j LEFT JOIN (SELECT event_id, props FROM events WHERE event_type IN ('purchase', 'click')) r
       ON r.event_id = j.job_id""",
)
def job_with_result(t):
    results = t("events").filter("event_type in ('purchase', 'click')").select(F.col("event_id").alias("job_id"), "props")
    return t("jobs").join(results, "job_id", "left").select("job_id", "status", "props")


@query("tail_events", "SELECT job_id, event_id, type FROM job_events WHERE job_id = 7 AND event_id > 100")
def tail_events(t):
    return service.tail_events(t("job_events"), 7, 100).select("job_id", "event_id", "type")


# Reviewers: every third job is resolved at the end of January 2024.
_REVIEWS = """
    SELECT e.job_id, ended AS created_at, e.job_id % 3 = 0 AND ended <= TIMESTAMP '2024-01-31 00:00:00' AS resolved FROM fin e WHERE type = 'needs_review'"""
_REVIEW_VIEWS = {"ev": _EV, "born": _BORN, "run": _RUN, "fin": _END, "review": _REVIEWS}


def _resolutions(t):
    jobs = t("job_events").filter("job_id % 3 = 0").select("job_id").distinct()
    return jobs.withColumn("ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("open_reviews", "SELECT job_id, epoch_us(created_at) AS created_us FROM review WHERE NOT resolved", _REVIEW_VIEWS)
def open_reviews(t):
    r = service.reviews(t("job_events"), _resolutions(t))
    return r.select("job_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@query("all_reviews", "SELECT job_id, resolved FROM review", _REVIEW_VIEWS)
def all_reviews(t):
    return service.reviews(t("job_events"), _resolutions(t), open_only=False).select("job_id", "resolved")


@query(
    "apply_corrections",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Corrected Ltd' ELSE buyer_name END AS buyer_name,
              CASE WHEN doc_id % 31 = 0 THEN CAST(1234.5 AS DOUBLE) ELSE CAST(grand_total AS DOUBLE) END AS grand_total, vendor_name FROM po_header""",
)
def apply_corrections(t):
    h = t("po_header")
    fix = lambda step, field, value, at: h.filter(f"doc_id % {step} = 0").select(
        "doc_id", F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(at).alias("at")
    )
    # many names are corrected twice
    name = fix(13, "buyer_name", "Corrected Ltd", 2).unionByName(fix(39, "buyer_name", "Zero Ltd", 1))
    fixed = service.apply_corrections(h, name.unionByName(fix(31, "grand_total", "1234.50", 1)))
    return fixed.select("doc_id", "buyer_name", F.col("grand_total").cast("double").alias("grand_total"), "vendor_name")


_MIX = "list_distinct(string_split(page_kinds, ' '))"
_PAGE_MIX = f"CASE WHEN len({_MIX}) = 1 THEN {_MIX}[1] WHEN len({_MIX}) > 1 THEN 'mixed' END"


@query("page_mix", f"SELECT job_id, {_PAGE_MIX} AS mix FROM jobs")
def page_mix(t):
    return t("jobs").select("job_id", service.page_mix(F.col("page_kinds")).alias("mix"))


@query(
    "metrics_window",
    f"""SELECT count(*) AS jobs, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in JOB_STATUSES)},
               round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.5), 6) AS latency_p50, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 6) AS latency_p95,
               CAST(max(latency_ms) AS DOUBLE) AS latency_max, round(quantile_cont(CAST(queue_ms AS DOUBLE), 0.95), 6) AS queue_p95,
               {', '.join(f"count(*) FILTER (WHERE {_PAGE_MIX} = '{k}') AS pages_{k}" for k in ('native', 'scanned', 'mixed'))},
               CAST(count(*) FILTER (WHERE status IN ('completed', 'needs_review') AND retried) AS DOUBLE)
                 / nullif(count(*) FILTER (WHERE status IN ('completed', 'needs_review')), 0) AS retry_rate
        FROM jobs WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7200 MINUTE""",
)
def metrics_window(t):
    return service.metrics(t("jobs"), "2024-01-20 00:00:00", 7200)
