"""Exact dedup, n-gram join and line dedup against brute force, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from poledger.llm import exact_dedup, line_dedup, ngram_join
from poledger.llm.components import components

DOC = "doc_id long, text string, place string, own_sha string, kept boolean"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], DOC)


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_are_the_smallest_reachable_nodes(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    want = {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items()}
    got = components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want


def test_no_edges_give_no_components(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


EXACT = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, None), (7, ""), (3, "a\tb"), (None, "a b"), (8, "x" * 200_000), (2, "x" * 200_000), *[(50 + i, "hot \n") for i in range(40)]]


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(docs_of(spark, EXACT), support=1 / 5).collect()
    assert len(got) == len(EXACT)
    by = {}
    for i, t in EXACT:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(x for x in v if x is not None), len(v)) for k, v in by.items()}
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(k for k, _ in want.values())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_survivors_keep_their_columns(spark):
    left = exact_dedup.drop_copies(docs_of(spark, EXACT))
    assert left.columns == ["doc_id", "text", "place", "own_sha", "kept"]
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 9, 50]


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_groups(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    links = [
        (a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x]
        if s and t and 100 * len(s & t) >= percent * len(s | t)
    ]
    found = roots(links)
    return {(i, len(s), found.get(i, i)) for i, s in sets}


def near_copies(seed, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.randrange(12, 90)) for _ in range(6)]
    rows = []
    for i in range(size):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        rows.append((i, " ".join(words)))
    common = " ".join(rng.choices(vocabulary, k=50))  # a passage that many share
    return rows + [(200 + i, f"{common} {' '.join(rng.choices(vocabulary, k=rng.randrange(3, 40)))}") for i in range(30)]


ODD = [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "Two\x0bwords"), (305, "one"), (306, "one"), (306, "one"), (307, "a b c d"), (None, "one")]


@pytest.mark.parametrize("n, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_jaccard_groups_match_brute_force(spark, monkeypatch, n, percent, seed):
    monkeypatch.setattr(ngram_join, "SALTED", 3)  # deal lists over tasks
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)  # several blocks in a family
    rows = near_copies(seed) + ODD
    got = ngram_join.jaccard_groups(docs_of(spark, rows), n, percent).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_groups(rows, n, percent)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_jaccard_links_are_counted_by_class(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, text), (2, text), (3, text + " end"), (4, "else")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_groups(docs_of(spark, rows), 4, 85).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}


def test_one_of_each_and_nothing(spark):
    rows = near_copies(5, 30) + ODD
    left = ngram_join.one_of_each(docs_of(spark, rows), 4, 85)
    want = sorted(i for i, _, root in brute_groups(rows, 4, 85) if i == root)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == want
    assert left.columns == ["doc_id", "text", "place", "own_sha", "kept"]
    assert ngram_join.jaccard_groups(docs_of(spark, [])).count() == 0


def test_list_edges_join_all_pairs_that_fit():
    rng = np.random.default_rng(1)
    for _ in range(400):
        size = int(rng.integers(1, 14))
        n = rng.integers(1, 40, size)
        most = n + rng.integers(-12, 6, size)
        u, v = ngram_join.list_edges(np.arange(size), n, most)
        found = roots(zip(u.tolist(), v.tolist(), strict=True))
        for i in range(size):
            for j in range(i):
                if n[j] <= most[i] and n[i] <= most[j]:
                    assert found.get(i, i) == found.get(j, j)


def test_overlaps_count_common_members():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(30, dtype=bool)  # a set with itself is not counted
    assert (ngram_join.overlaps(sets, None) == want)[off].all()
    assert (ngram_join.overlaps(sets[:10], sets[10:]) == want[:10, 10:]).all()


def brute_lines(rows, least):
    """First owner of each line; longest runs found by trying all alignments is not needed: the
    documents of the test repeat no line, so the matched pairs are the longest rising run."""
    order = sorted({(i, t) for i, t in rows}, key=lambda r: r[0])
    owner, out = {}, {}
    for i, t in order:
        lines = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip()]
        held = {}
        for place, (k, x) in enumerate(lines):
            if x in owner:
                held.setdefault(owner[x][0], []).append((place, owner[x][1], k, len(x.split())))
        gone = []
        for pairs in held.values():
            best = [[p] for p in pairs]
            for a in range(len(pairs)):
                for b in range(a):
                    if pairs[b][1] < pairs[a][1] and len(best[b]) + 1 > len(best[a]):
                        best[a] = best[b] + [pairs[a]]
            run = max(best, key=len)
            start = 0
            for a in range(1, len(run) + 1):
                if a == len(run) or run[a][:2] != (run[a - 1][0] + 1, run[a - 1][1] + 1):
                    if sum(p[3] for p in run[start:a]) >= least:
                        gone += [p[2] for p in run[start:a]]
                    start = a
        for place, (_, x) in enumerate(lines):
            owner.setdefault(x, (i, place))
        out[i] = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone) if gone else t
    return out


def test_line_blocks_go_from_later_documents(spark):
    rng = random.Random(4)
    passages = [[f"passage {p} line {k} " + "word " * rng.randrange(1, 9) for k in range(rng.randrange(1, 5))] for p in range(8)]
    rows = []
    for i in range(40):
        parts = [[f"own {i} {k}"] if rng.random() < 0.5 else [""] for k in range(3)] + rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, "\n".join(x for p in parts for x in p)))
    rows += [(90, None), (91, ""), (92, rows[0][1]), (92, rows[0][1])]
    got = line_dedup.without_copies(docs_of(spark, rows), 8)
    assert got.columns == ["doc_id", "text", "place", "own_sha", "kept"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.text for r in found} == brute_lines(rows, 8)


def brute_pairs(rows, least):
    """(by runs, by patience): per document the lines that go when every pair is looked at."""
    docs = sorted({(i, t) for i, t in rows})
    runs, patience = {}, {}
    for n, (i, t) in enumerate(docs):
        here = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip()]
        runs[i], patience[i] = set(), set()
        for _, u in docs[:n]:
            there = [x for x in u.split("\n") if x.strip()]
            shared = [([a for a, y in enumerate(here) if y[1] == x], [b for b, y in enumerate(there) if y == x]) for x in {x for _, x in here} & set(there)]
            every = {(a, b) for places in shared for a in places[0] for b in places[1]}
            chains = [[(a + k, b + k) for k in range(len(here)) if all((a + j, b + j) in every for j in range(k + 1))] for a, b in every if (a - 1, b - 1) not in every]
            for out, blocks in ((runs, chains), (patience, line_dedup.blocks(line_dedup.aligned(shared)))):
                for block in blocks:
                    if sum(len(here[a][1].split()) for a, _ in block) >= least:
                        out[i] |= {here[a][0] for a, _ in block}
    return runs, patience


def test_blocks_of_many_owners_go_whole(spark):
    block = [f"short line {k}" for k in range(12)]
    rows = [(k, f"own {k}\n{block[k]}") for k in range(6)] + [(10, "\n".join(block)), (11, "\n".join(block)), (12, "new\n" + "\n\n".join(block[3:9]) + "\nend")]
    rows += [(20, "a b c\nd e f\na b c\ng h i\na b c\nj k l"), (21, "x\na b c\nd e f\na b c\ng h i\na b c\nj k l"), (22, "g h i\na b c\nj k l\nd e f")]
    got = {r.doc_id: r for r in line_dedup.removals(docs_of(spark, rows), 10).collect()}
    assert {i: (list(r.gone), r.gone_words) for i, r in got.items()} == {11: (list(range(12)), 36), 12: ([1, 3, 5, 7, 9, 11], 18), 21: (list(range(1, 7)), 18)}


def test_line_blocks_match_all_pairs(spark):
    rng = random.Random(8)
    lines = [f"l{k} " + "w " * rng.randrange(4) for k in range(9)]
    rows = [(i, "\n".join(rng.choice([*lines, *lines, "", f"own {i}"]) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    rows += [(100 + i, rows[rng.randrange(40)][1] + "\n" + rows[rng.randrange(40)][1]) for i in range(20)]
    got = {r.doc_id: set(r.gone) for r in line_dedup.removals(docs_of(spark, rows), 7).collect()}
    runs, patience = brute_pairs(rows, 7)
    assert got == {i: v for i, v in brute_rounds(rows, 7).items() if v}
    assert all(v <= runs[i] for i, v in got.items())
    found, wanted = sum(len(got.get(i, set()) & v) for i, v in patience.items()), sum(map(len, patience.values()))
    assert wanted and found >= 0.99 * wanted  # pairs with other than owners may break ties of order differently


def longest_rise(pairs):
    """Length of the longest run that rises in both places, by trying all."""
    best = [1] * len(pairs)
    for a in range(len(pairs)):
        best[a] = 1 + max((best[b] for b in range(a) if pairs[b][0] < pairs[a][0] and pairs[b][1] < pairs[a][1]), default=0)
    return max(best, default=0)


def brute_rounds(rows, least):
    """Owners of all stretches by their lines; every pair aligned; what stays looks for an owner again."""
    docs = sorted({(i, t) for i, t in rows})
    held, raw, gone = {}, {}, {}
    for i, t in docs:
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip()]
        size = [len(x.split()) for _, x in lines]
        raw[i], gone[i], spans, times = [k for k, _ in lines], set(), set(), {}
        for a in range(len(lines)):
            spans |= {next(((a, b) for b in range(a + 1, len(lines) + 1) if sum(size[a:b]) >= least), None)}
            spans |= {next(((b, a + 1) for b in range(a, -1, -1) if sum(size[b : a + 1]) >= least), None)}
        held[i] = []
        for a, b in sorted(spans - {None}):
            key = tuple(x for _, x in lines[a:b])
            times[key] = times.get(key, 0) + 1
            held[i].append((a, b, (key, times[key])))
    while True:
        owners = {}
        for i, _ in docs:
            for a, _, key in held[i]:
                owners.setdefault(key, (i, a))
        again = {}
        for i, _ in docs:
            pairs = {}
            for a, b, key in held[i]:
                if owners[key][0] != i:
                    pairs.setdefault(owners[key][0], []).append((a, owners[key][1], b, key))
            taken, crossed = set(), []
            for found in pairs.values():
                found.sort(key=lambda p: p[:3])
                heads = [p for k, p in enumerate(found) if not k or p[0] != found[k - 1][0]]
                run = set(line_dedup.aligned([([p[0]], [p[1]]) for p in heads]))
                assert len(run) == longest_rise(heads)
                for p in found:
                    if p[:2] in run:
                        taken |= set(range(p[0], p[2]))
                    else:
                        crossed.append(p)
            gone[i] |= {raw[i][k] for k in taken}
            again[i] = [(a, b, key) for a, _, b, key in crossed if not set(range(a, b)) <= taken]
        held = again
        if not any(held.values()):
            return gone


def test_lines_in_another_order_stay(spark):
    lines = [f"line {k} has more than ten words of its own and so it is a block" for k in range(3)]
    rows = [(1, "\n".join(lines), "x", 7, None), (2, "\n".join(lines[::-1]), "y", 8, None), (3, "\n".join(lines[::-1]), "z", 9, 1), (4, lines[1], "z", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, gone_words int, doc int")
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert [got[i].n_gone for i in (1, 2, 3, 4)] == [0, 1, 3, 1]
    assert line_dedup.without_copies(docs).columns == docs.columns


def test_repeated_lines_are_matched_inside_their_gap():
    assert line_dedup.aligned([([1], [1]), ([0, 2], [2, 5])]) == [(1, 1), (2, 2)]


def test_patience_takes_unique_lines_first_and_then_repeats():
    assert line_dedup.aligned([([0], [5]), ([1], [6]), ([2], [1])]) == [(0, 5), (1, 6)]
    assert line_dedup.aligned([([0, 3], [0, 2]), ([1], [1])]) == [(0, 0), (1, 1), (3, 2)]
    assert line_dedup.blocks([(0, 0), (1, 1), (3, 2)]) == [[(0, 0), (1, 1)], [(3, 2)]]
    assert line_dedup.aligned([]) == []


def test_line_report_of_nothing(spark):
    assert line_dedup.line_report(docs_of(spark, [])).count() == 0


def test_links_of_very_long_texts_are_exact():
    """671,109 of 730,324 and 730,325 n-grams: 100 * common = 85 * union, which a float32 product misses."""
    common, a, b = 671_109, 730_324, 730_325
    sets = [np.arange(a, dtype=np.uint64), np.r_[np.arange(common), np.arange(2_000_000, 2_000_000 + b - common)].astype(np.uint64)]
    counts = ngram_join.overlaps(sets, None)
    assert counts.dtype == np.int64 and counts[0, 1] == common and 100 * counts[0, 1] >= 85 * (a + b - counts[0, 1])
