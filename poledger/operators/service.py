"""Service tables in batch: submissions, job states, reviews, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.operators.quantiles import beside, exact
from poledger.refdata import HEADER_FIELDS, JOB_STATUSES

FINAL = ("completed", "needs_review", "failed")


def submit(submissions: DataFrame) -> DataFrame:
    """(job_id, po_seq, created): the first arrival of a file's SHA-256 creates the job.

    The first arrival is a partial aggregate, so many copies of one file fold before the shuffle.
    """
    s = submissions.select(F.sha2("text", 256).alias("job_id"), "po_seq")
    first = s.groupBy("job_id").agg(F.min("po_seq").alias("first"))
    return s.join(first, "job_id").select("job_id", "po_seq", (F.col("po_seq") == F.col("first")).alias("created"))


STATE_COLUMNS = (
    "status string, attempts int, queue_ms double, latency_ms double, wrong int"
)


class JobState:
    """The lifecycle of one job as a stream sees it: what each event may do in each status."""

    __slots__ = ("created", "status", "attempts", "queue_ms", "latency_ms", "wrong")

    def __init__(self) -> None:
        self.created, self.status, self.attempts = None, None, 0
        self.queue_ms, self.latency_ms, self.wrong = None, None, 0

    def apply(self, kind: str, ts_us: int) -> None:
        if kind == "queued":
            if self.status is None:
                self.status, self.created = "queued", ts_us
            return
        allowed = {"processing": ("queued", "processing"), "failed": ("queued", "processing")}
        if self.status not in allowed.get(kind, ("processing",)):
            self.wrong += 1
            return
        waited = (ts_us - self.created) / 1000
        if kind == "processing":
            self.attempts += 1
            self.queue_ms = waited if self.queue_ms is None else self.queue_ms
        else:
            self.latency_ms = waited
        self.status = kind

    def row(self, job) -> tuple:
        return (job, self.status, self.attempts, self.queue_ms, self.latency_ms, self.wrong)


def lifecycles(events: DataFrame) -> DataFrame:
    """(job_id, born, run, fin): what counts in a job's life, each with its place in time. It is born
    with its first queued event and ends with the first failure after that, or the first end of
    another kind after its first processing event. All else is wrong or repeats.

    Three minima, so the events of a busy job fold before any shuffle.
    """
    e = events.select(
        F.col("job_id").alias("job"), "type", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("at")
    )
    born = e.filter("type = 'queued'").groupBy(F.col("job").alias("job_id")).agg(F.min("at").alias("born"))
    alive = e.filter("type <> 'queued'").join(born, F.col("job") == F.col("job_id")).filter("at > born")
    run = alive.filter("type = 'processing'").groupBy("job").agg(F.min("at").alias("run"))
    ends = alive.filter("type in ('failed', 'completed', 'needs_review')").join(run, "job", "left")
    fin = ends.filter("type = 'failed' or at > run").groupBy("job").agg(F.min(F.struct("at", "type")).alias("fin"))
    jobs = e.select(F.col("job").alias("job_id")).distinct().join(born, "job_id", "left")
    return jobs.join(run.withColumnRenamed("job", "job_id"), "job_id", "left").join(fin.withColumnRenamed("job", "job_id"), "job_id", "left")


def job_state(events: DataFrame) -> DataFrame:
    """Final state of every job: status, attempts, waiting and running time, events out of order."""
    lives = lifecycles(events).withColumnRenamed("job_id", "job")
    at = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id"))
    j = events.select("job_id", "type", at.alias("at")).join(lives, F.col("job_id") == F.col("job"))
    tried = (F.col("type") == "processing") & (F.col("at") > F.col("born")) & (F.col("fin").isNull() | (F.col("at") < F.col("fin.at")))
    per = j.groupBy("job_id", "born", "run", "fin").agg(
        F.count_if(tried).cast("int").alias("attempts"), F.count_if(F.col("type") != "queued").alias("others")
    )
    waited = lambda c: (F.col(f"{c}.us") - F.col("born.us")) / 1000
    status = F.when(F.col("fin").isNotNull(), F.col("fin.type")).when(F.col("attempts") > 0, "processing").when(F.col("born").isNotNull(), "queued")
    return per.select(
        "job_id", status.alias("status"), "attempts", F.when(F.col("attempts") > 0, waited("run")).alias("queue_ms"), waited("fin.at").alias("latency_ms"),
        (F.col("others") - F.col("attempts") - F.col("fin").isNotNull().cast("int")).cast("int").alias("wrong"),
    )


def list_jobs(jobs: DataFrame, status: str | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, ties by arrival: a distributed top-k."""
    if status is not None and status not in JOB_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    if status:
        jobs = jobs.filter(F.col("status") == status)
    if since:
        jobs = jobs.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return jobs.orderBy(F.desc("created_at"), F.desc("po_seq")).limit(limit)


def tail_events(events: DataFrame, job_id: int, after_id: int = 0) -> DataFrame:
    return events.filter((F.col("job_id") == job_id) & (F.col("event_id") > after_id)).orderBy("event_id")


def reviews(events: DataFrame, resolutions: DataFrame, open_only: bool = True) -> DataFrame:
    """(job_id, created_at, resolved): a job whose accepted end is needs_review opens a review; only a
    reviewer resolves it. resolutions: job_id, ts; those before the review opened do not count."""
    opened = lifecycles(events).filter("fin.type = 'needs_review'").select("job_id", F.timestamp_micros("fin.at.us").cast("timestamp_ntz").alias("created_at"))
    done = resolutions.groupBy("job_id").agg(F.max("ts").cast("timestamp_ntz").alias("done_at"))
    out = opened.join(done, "job_id", "left").select("job_id", "created_at", F.coalesce(F.col("done_at") >= F.col("created_at"), F.lit(False)).alias("resolved"))
    return (out.filter("not resolved") if open_only else out).orderBy("created_at", "job_id")


def apply_corrections(header: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected text fields; of several corrections of a field the latest counts (the largest
    value among equals). corrections: doc_id, field, value, at. They fold to one map per document
    (at most 58 fields), so the header stays wide."""
    latest = corrections.groupBy("doc_id", "field").agg(F.max(F.struct("at", "value"))["value"].alias("value"))
    pairs = latest.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fix"))
    j = header.join(pairs, "doc_id", "left")
    return j.select("doc_id", *[
        F.coalesce(F.try_element_at("fix", F.lit(f)).try_cast(header.schema[f].dataType), F.col(f)).alias(f)
        for f in HEADER_FIELDS
    ])


def page_mix(kinds):
    """The single kind of a job's pages, else mixed; null without pages."""
    distinct = F.array_distinct(F.split(kinds, " "))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, "mixed")


def metric_columns(quantiles: bool = True) -> list:
    """Aggregates shared by the batch metrics and the streaming window; the latter has its quantiles
    in the window's own state, which holds the jobs of one window."""
    p = lambda c, q: F.round(F.percentile(F.col(c).cast("double"), F.lit(q)), 6)
    checked = F.col("status").isin("completed", "needs_review")
    return [
        F.count("*").alias("jobs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES],
        *([p("latency_ms", 0.5).alias("latency_p50"), p("latency_ms", 0.95).alias("latency_p95"), p("queue_ms", 0.95).alias("queue_p95")] if quantiles else []),
        F.max(F.col("latency_ms").cast("double")).alias("latency_max"),
        *[F.count_if(page_mix(F.col("page_kinds")) == k).alias(f"pages_{k}") for k in ("native", "scanned", "mixed")],
        F.try_divide(F.count_if(checked & F.col("retried")).cast("double"), F.count_if(checked).cast("double")).alias("retry_rate"),
    ]


def metrics(jobs: DataFrame, now: str, window_minutes: int = 60) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(window_minutes)} MINUTE")
    recent = jobs.filter(F.col("created_at") >= since)
    out = beside(recent.agg(*metric_columns(quantiles=False)), exact(recent, F.col("latency_ms"), {"latency_p50": 0.5, "latency_p95": 0.95}))
    return beside(out, exact(recent, F.col("queue_ms"), {"queue_p95": 0.95}))
