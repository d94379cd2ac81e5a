"""Values looked for in whole documents, against a search of the joined text."""

import random
import re

import pytest

from poledger.operators import pages


def brute(docs, values):
    """Verdict of each value by the rule's own words: the text of all kept pages in order."""
    out = {}
    for d, value in values:
        needle = re.sub(r"[^A-Z0-9]", "", value.upper())
        texts = [t for _, t, kept in sorted(docs.get(d, []), key=lambda p: p[0]) if kept]
        if d not in docs or not texts:
            out[d, value] = "unverifiable"
            continue
        tokens = [x for t in texts for x in re.split(r"[^A-Z0-9]+", t.upper()) if x]
        whole = "".join(tokens)
        ends, at = [0], 0
        for x in tokens:
            at += len(x)
            ends.append(at)
        places = [m.start() for m in re.finditer(f"(?={needle})", whole)] if needle else []
        hit = bool(places) if len(needle) >= 8 else any(p in ends and p + len(needle) in ends for p in places)
        out[d, value] = "yes" if hit else "no" if needle and all(texts) else "unverifiable"
    return out


def run(spark, docs, values):
    rows = [(d, n, t, kept) for d, ps in docs.items() for n, t, kept in ps]
    features = spark.createDataFrame(rows, "doc_id long, page_no int, layer string, kept boolean")
    asked = spark.createDataFrame([(d, v, 1) for d, v in values], "doc_id long, value string, page_no int")
    return {(r.doc_id, r.value): r.verdict for r in pages.ground(asked, features).collect()}


def test_a_value_over_three_pages(spark):
    docs = {1: [(1, "PO 29AAB", True), (2, "CX0", True), (3, "000K1Z5 end", True)], 2: [(1, "a 73", True), (2, "08", True), (3, "11", True), (4, "x", True)]}
    values = [(1, "29AABCX0000K1Z5"), (1, "29AABCX0000K1Z6"), (2, "730811"), (2, "73081"), (2, "30811"), (2, "a730811x"), (1, "--")]
    got = run(spark, docs, values)
    assert got == brute(docs, values)
    assert got[1, "29AABCX0000K1Z5"] == got[2, "730811"] == got[2, "a730811x"] == "yes" and got[2, "73081"] == "no"


@pytest.mark.parametrize("block", [4096, 40])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pages, "BLOCK", block)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab1  -\n") for _ in range(n))
    docs = {d: [(n, text(rng.choice((0, 3, 30, 300))), rng.random() < 0.9) for n in range(1, 7)] for d in range(12)}
    docs[50] = [(n, "x" if n % 3 else "", True) for n in range(1, 60)]
    docs[51] = [(1, "long " * 4000 + "needle in hay", True), (2, "stack" * 300, True)]
    values = {(d, text(rng.choice((1, 2, 4, 7, 9, 12, 20)))) for d in (*range(12), 99) for _ in range(25)}
    for d in range(12):  # values that do stand there, over breaks of tokens and pages
        whole = " ".join(t for _, t, kept in docs[d] if kept)
        values |= {(d, whole[at : at + rng.choice((3, 8, 9, 30))]) for at in (rng.randrange(max(1, len(whole))) for _ in range(15))}
    values |= {(50, "x" * 9), (50, "xxx"), (50, "x" * 50), (51, "needle in hay stack"), (51, "stack" * 290), (51, "stack" * 301)}
    values = sorted(v for v in values if v[1])
    assert run(spark, docs, values) == brute(docs, values)


def test_nothing_to_search(spark):
    assert run(spark, {1: [(1, "", True)]}, [(1, "abc"), (1, "abcdefgh")]) == {(1, "abc"): "unverifiable", (1, "abcdefgh"): "unverifiable"}
    assert run(spark, {1: [(1, "found here", True)]}, [(1, "found")]) == {(1, "found"): "yes"}
