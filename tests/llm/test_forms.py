"""Chat formatting, WARC archives, the quality model and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from poledger.llm import chat_format, decontaminate, mixing, ngram_join, quality, sharding, warc
from poledger.plans.staging import place, settle

SF = "/root/testdata/sf0.001"
TEMPLATE = chat_format.Template()


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="<s>/[INSTANRO]\\ aé\n", max_size=60))
def test_escapes_are_reversible(text):
    escaped = chat_format.escaper(TEMPLATE)(text)
    assert chat_format.unescaped(escaped) == text
    assert not any(m in escaped for m in TEMPLATE.marks())


def test_marks_must_be_apart():
    with pytest.raises(ValueError):
        chat_format.Template(begin="<<s>").marks()
    with pytest.raises(ValueError):
        chat_format.Template(end="<s>").marks()


TALK = [
    (1, 1, "assistant", "hi </s>"), (1, 0, "user", "[INST]\\"), (2, 0, "assistant", "first"), (2, 1, "tool]", None), (3, 0, None, ""), (4, 5, "user", "b"), (4, 5, "user", "b"),
    (5, 0, "system", "s"), (5, 1, "user", "u" * 300_000), (5, 2, "assistant", "[/ANS] é"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (6, None, "user", "n"), (6, 0, "assistant", "m"),
]


def test_conversations_come_back(spark):
    rows = spark.createDataFrame([(*r, "z", False) for r in TALK], "conv_id long, turn long, role string, text string, kind string, loss boolean")
    parts = settle(chat_format.segments(rows), "talk")
    got = {r.conv_id: r for r in chat_format.turns_of(parts).collect()}
    whole = {r.conv_id: r for r in chat_format.rendered(parts).collect()}
    by = {}
    for c, t, role, text in sorted(TALK, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r, learnt = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars == len(whole[c].formatted)
        spans = "".join(chat_format.unescaped(whole[c].formatted[s["from"] : s["to"]]) for s in whole[c].loss_spans)
        assert spans == learnt
    assert {c for c, r in got.items() if r.valid} == {1, 5, None, 6}
    assert chat_format.segments(rows.limit(0)).count() == 0


PAGES = [
    (1, "http://B.example.org/x?q=1#f", "p" * 1500), (2, "http://a.b.example.org", "p" * 1500), (3, None, "small"), (4, "u r\nl", "small"), (5, "http://c.org/", None),
    (6, "http://c.org/", "é\r\n\r\nWARC/1.1\r\n" * 90), (7, "http://c.org/2", "é\r\n\r\nWARC/1.1\r\n" * 90), (7, "http://c.org/2", "é\r\n\r\nWARC/1.1\r\n" * 90), (None, "http://d.org/", "x"), (8, "http://c.org/", "big" * 100_000),
]


def test_archives_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_BLOCK", 3)
    path = place(spark, "warc")
    pages = spark.createDataFrame([(*r, "d", 1) for r in PAGES], "page_id long, url string, html string, digest string, bytes int").repartition(3)
    warc.write_archive(pages, path)
    index = warc.build_index(warc.scan(spark, path))
    found = warc.resolved(warc.records(warc.captures_of(index))).collect()
    raw = {i: (h or "").encode() for i, _, h in PAGES}
    last = {1: 2, 6: 7}
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == sorted(
        (str(i), len(raw[i]), hashlib.sha1(raw[i]).hexdigest(), "revisit" if i in last else "response", str(last.get(i))) for i, _, _ in PAGES
    )
    hits = warc.lookup(index, ["http://c.org/", "http://A.B.example.org", "http://none.org/"])
    assert sorted(r.page_id for r in hits.collect()) == [2, 5, 6, 8]
    assert {r.page_id: bytes(r.payload) for r in warc.records(hits.where("record_type = 'response'")).collect()} == {i: raw[i] for i in (2, 5, 8)}
    keys = [r.urlkey for r in warc.captures_of(index).collect()]
    assert "org,example,b)/x?q=1" in keys and len(keys) == len(PAGES)


def test_empty_archive(spark):
    path = place(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.records(warc.captures_of(warc.build_index(warc.scan(spark, path))))).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.scores(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert len(quality.accepted(docs, model).columns) == len(docs.columns)


def test_quality_cases(spark):
    rows = [(1, None, None), (1, "", 3), (None, "A!! B!!", 7), (2, "w " * 100_000, 9)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, n_chars long, score double")
    for labels in ([], [(1, 1), (1, 0), (2, None)], [(2, 1), (7, 1), (1, 1)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.scores(docs, model).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.accepted(docs, model).columns == docs.columns and quality.scores(docs.limit(0), model).count() == 0


def test_factors_are_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((0, 7)), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    at, x = np.array([1, 4, 6]), np.array([0.2, 0.5, 0.7])
    z = 0.3 + m.linear[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(m.score(at, x) - 1 / (1 + np.exp(-z))) < 1e-12


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(settle(stage(spark, held[-1], SF), name))
    rows = [h.select("doc_id", "text", "source").collect() for h in held]
    assert list(stages) == ["quality", "near_copies", "benchmarks", "mix", "shards"]
    assert all(h.columns == docs.columns for h in held[:-1])
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fine = {r.doc_id for r in quality.scores(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in rows[1]} == fine
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows[1] if (w := r.text.encode().lower().split())}
    linked = {a for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    left = {r.doc_id for r in rows[2]}
    assert left >= set(sets) - linked and all(any(b in left for b in sets) for _ in linked)
    groups = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(held[1]).collect()}
    assert left == {d for d, c in groups.items() if d == c}
    hits = {r.doc_id for r in decontaminate.contamination(held[2], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in rows[3]} == left - hits
    shares = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(held[3]).collect() if r.size}
    assert sorted(r.doc_id for r in rows[4]) == sorted(d for d, n in shares.items() for _ in range(n))
    want = held[4].select("doc_id", sharding.rendezvous(F.col("doc_id"), [1.0] * 16).alias("shard"))
    assert sorted(held[5].select("doc_id", "shard").collect()) == sorted(want.collect())
