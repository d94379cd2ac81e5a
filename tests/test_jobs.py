"""Gaps, row matching, service states and streams against brute force."""

import random

from pyspark.sql import functions as F

from poledger.functions.fuzzy import token_set
from poledger.operators import gaps, scoring, service
from poledger.sources import bridge
from poledger.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_gaps_across_blocks(spark):
    docs = {1: [1, 2, 5], 2: [10, 30, 40], 3: [3], 4: [1, gaps.BLOCK * 2 + 3], 5: [1, 2], 6: [0, 2]}
    rows = [(d, n, f"LI-p{n % 3}") for d, ns in docs.items() for n in ns]
    g = gaps.line_gaps(spark.createDataFrame(rows, "doc_id bigint, line_no int, call_id string"))
    got = {}
    for r in gaps.missing_numbers(g).collect():
        got.setdefault(r["doc_id"], set()).add(r["line_no"])
    for d, ns in docs.items():
        step = 10 if all(n % 10 == 0 for n in ns) else 1
        assert got.get(d, set()) == set(range(step, max(ns) + 1, step)) - set(ns), d


def test_row_matching_is_the_greedy_one(spark):
    rng = random.Random(5)
    words = ["bolt", "bolts", "nut", "seal", "kit", "ring", "rings", "long"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    truth = {d: [(i, i + 1, rng.choice("AB"), rng.randint(1, 2), text()) for i in range(6)] for d in range(15)}
    pred = {d: [(i, None if rng.random() < 0.7 else rng.randint(1, 7), rng.choice("AB"), rng.randint(1, 2), text()) for i in range(6)] for d in range(15)}
    schema = "doc_id bigint, idx int, line_no int, item_code string, quantity int, description string"
    frame = lambda side: spark.createDataFrame([(d, *r) for d, rows in side.items() for r in rows], schema)
    got = {tuple(r)[:3] for r in scoring.match_rows(frame(truth), frame(pred)).collect()}
    want = set()
    for d in truth:
        nums = [r[1] for r in pred[d]]
        by_no = {r[1]: r[0] for r in truth[d]}
        m = [(by_no[r[1]], r[0]) for r in pred[d] if r[1] is not None and nums.count(r[1]) == 1 and r[1] in by_no]
        ut, up = {t for t, _ in m}, {p for _, p in m}
        cand = []
        for t in truth[d]:
            for p in pred[d]:
                if t[0] in ut or p[0] in up:
                    continue
                code, qty, sim = t[2] == p[2], t[3] == p[3], token_set(t[4], p[4])
                if sim >= 80 or (code and qty):
                    cand.append((-(code + qty + sim / 100), t[0], p[0]))
        for _, t, p in sorted(cand):
            if t not in ut and p not in up:
                m.append((t, p))
                ut.add(t)
                up.add(p)
        want |= {(d, t, p) for t, p in m}
    assert got == want


def _events_dir(spark, tmp_path, name):
    path = str(tmp_path / name)
    bridge.table(spark, SF, name).coalesce(1).write.parquet(path)
    return path


def test_job_state_stream_equals_batch(spark, tmp_path):
    path = _events_dir(spark, tmp_path, "job_events")
    schema = spark.read.parquet(path).schema
    q = (
        jobs.job_state(spark.readStream.schema(schema).parquet(path))
        .writeStream.format("memory").queryName("states").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = sorted(map(str, spark.table("states").collect()))
    assert got == sorted(map(str, service.job_state(bridge.table(spark, SF, "job_events")).collect()))


def test_submit_stream_drops_copies(spark, tmp_path):
    path = str(tmp_path / "subs")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs.coalesce(1).write.parquet(path)
    q = (
        jobs.submit(spark.readStream.schema(docs.schema).parquet(path))
        .writeStream.format("memory").queryName("subs").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert spark.table("subs").count() == docs.select("text").distinct().count()


def test_metric_windows_equal_batch(spark, tmp_path):
    path = _events_dir(spark, tmp_path, "jobs")
    schema = spark.read.parquet(path).schema
    q = (
        jobs.metrics(spark.readStream.schema(schema).parquet(path))
        .writeStream.format("memory").queryName("metrics").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    batch = bridge.table(spark, SF, "jobs").withColumn("created_at", F.col("created_at").cast("timestamp"))
    w = F.window("created_at", "60 minutes", "5 minutes")
    want = {r["start"]: r for r in batch.groupBy(w).agg(*service.metric_columns()).select("window.start", "*").drop("window").collect()}
    got = spark.table("metrics").drop("end").collect()
    assert got and all(want[r["start"]].asDict() == r.asDict() for r in got)
