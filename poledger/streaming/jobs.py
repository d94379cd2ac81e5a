"""The service tables as streams: event time, a ten-minute watermark, checkpointed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.operators import service

WATERMARK = "10 minutes"


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the tables carry plain ones (UTC)."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, WATERMARK)


def submit(submissions: DataFrame) -> DataFrame:
    """New jobs only: a file's first arrival within the watermark passes, repeats are dropped."""
    s = submissions.withColumn("job_id", F.sha2("text", 256)).drop("text")
    return with_event_time(s).dropDuplicatesWithinWatermark(["job_id"])


def metrics(jobs: DataFrame) -> DataFrame:
    """Trailing-hour service metrics every five minutes."""
    j = with_event_time(jobs, "created_at")
    w = F.window("created_at", "60 minutes", "5 minutes")
    return j.groupBy(w).agg(*service.metric_columns()).select("window.start", "window.end", "*").drop("window")


STATE = "created long, status string, attempts int, queue_ms double, latency_ms double, wrong int"


def job_state(events: DataFrame, idle: str = "7 days") -> DataFrame:
    """Each job's state after every batch that touches it. Finished jobs leave the state store
    once nothing came for `idle`."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job = service.JobState()
        if state.exists:
            job.created, job.status, job.attempts, job.queue_ms, job.latency_ms, job.wrong = state.get
        newest = 0
        # one micro-batch of one job, bounded by the source's batch limit; three columns of it
        found = [t for b in batches for t in zip(b["us"].tolist(), b["event_id"].tolist(), b["type"].tolist(), strict=True)]
        for us, _, kind in sorted(found):
            job.apply(kind, us)
            newest = max(newest, us)
        state.update((job.created, job.status, job.attempts, job.queue_ms, job.latency_ms, job.wrong))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([job.row(key[0])], columns=["job_id", *(c.split()[0] for c in service.STATE_COLUMNS.split(", "))])

    e = with_event_time(events).withColumn("us", F.unix_micros("ts"))
    kind = events.schema["job_id"].dataType.simpleString()  # numbers or SHA-256 strings
    return e.groupBy("job_id").applyInPandasWithState(
        update, f"job_id {kind}, {service.STATE_COLUMNS}", STATE, "update", "EventTimeTimeout"
    )


def tail(events: DataFrame, job_id: int) -> DataFrame:
    """A job's events as they arrive; the source's checkpoint plays the part of the last id seen."""
    return events.filter(F.col("job_id") == job_id)
