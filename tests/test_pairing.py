"""Greedy pairs of rows against brute force over all pairs."""

import random

import pytest

from poledger.functions.fuzzy import token_set
from poledger.operators import pairing

ROWS = "doc_id {}, idx int, item_code string, quantity string, description string"
NONE = "doc_id {}, t_idx int, p_idx int"


def score(t, p):
    code, qty = bool(t[1]) and t[1] == p[1], bool(t[2]) and t[2] == p[2]
    words = (t[3] or "").lower(), (p[3] or "").lower()
    alike = token_set(*words) if all(words) else 0.0
    return code + qty + alike / 100 if alike >= 80 or (code and qty) else None


def brute(truth, pred):
    out = set()
    for d in truth:
        found = [(-s, t[0], p[0]) for t in truth[d] for p in pred.get(d, []) if (s := score(t, p)) is not None]
        used_t, used_p = set(), set()
        for _, t, p in sorted(found):
            if t not in used_t and p not in used_p:
                out.add((d, t, p))
                used_t.add(t)
                used_p.add(p)
    return out


def run(spark, truth, pred, key="bigint"):
    frame = lambda side: spark.createDataFrame([(d, *r) for d, rows in side.items() for r in rows], ROWS.format(key))
    got = pairing.match_by_content(frame(truth), frame(pred), spark.createDataFrame([], NONE.format(key))).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


WORDS = {
    "few words, many ties": ["bolt", "bolts", "nut", "kit", "ring"],
    "misspelt words": ["hexagon", "hexagno", "hexgon", "gasket", "gaskt", "gaskets", "flange", "falnge", "a", "ab", "m8", "m10"],
}


@pytest.mark.parametrize("words", WORDS.values(), ids=WORDS.keys())
def test_pairs_are_the_greedy_ones(spark, words):
    rng = random.Random(len(words))

    def side(most):
        text = lambda: rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        row = lambda i: (i, rng.choice(["A", "B", None]), rng.choice(["1.00", "2.00", None]), text())
        return {d: [row(i) for i in range(rng.randint(0, most))] for d in range(40)}

    truth, pred = side(12), side(12)
    assert run(spark, truth, pred) == brute(truth, pred)


def test_long_documents_of_look_alikes(spark):
    same = [(i, None, None, "steel bolt") for i in range(60)]
    numbered = lambda step: [(i, None, f"{step * i + 1}.00", "steel bolt") for i in range(60)]
    mixed = [(i, None, f"{i % 3}.00", ["steel bolt", "steel bolts"][i % 2]) for i in range(60)]
    truth = {"same": same, "none agree": numbered(2), "some agree": numbered(1), "cycles": mixed, "alone": same}
    pred = {"same": same[:41], "none agree": [(i, c, f"{2 * i + 2}.00", x) for i, c, _, x in same], "some agree": numbered(3), "cycles": mixed[7:]}
    assert run(spark, truth, pred, "string") == brute(truth, pred)


def test_no_rows(spark):
    assert run(spark, {1: []}, {1: []}) == set()
    assert run(spark, {1: [(0, "A", "1.00", "x")]}, {2: [(0, "A", "1.00", "x")]}) == set()


def test_filters_lose_no_pair(spark):
    """Random short texts: every pair of a similarity of 80 is a candidate."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3)))
    texts = {s: {i: text() for i in range(150)} for s in ("t_idx", "p_idx")}
    keys = {
        s: spark.createDataFrame([(1, "", "", x, i) for i, x in rows.items()], f"doc_id bigint, code string, qty string, text string, {s} int")
        for s, rows in texts.items()
    }
    got = {(r.t_idx, r.p_idx) for r in pairing.candidates(keys["t_idx"], keys["p_idx"]).collect()}
    assert got == {(i, j) for i, t in texts["t_idx"].items() for j, p in texts["p_idx"].items() if token_set(t, p) >= 80}
