"""Sharding, mixing, decontamination and licences: laws and defined cases."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from poledger.llm import decontaminate, licenses, mixing, sharding
from poledger.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, shard string, copies int, size int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], DOC)


def plain_shard(key, weights):
    """Highest score of the key with each shard, the lower shard on equal ones."""
    def score(shard):
        first = xxhash.xxh64_intdigest(f"shards:{shard}".encode(), seed=42)
        bits = xxhash.xxh64_intdigest(("null" if key is None else str(key)).encode(), seed=first)
        return -weights[shard] / math.log(((bits >> 11) + 0.5) / 2**53)

    return max((i for i, w in enumerate(weights) if w), key=lambda i: (score(i), -i))


def test_shards_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op10_sharding"][0](spark, SF).collect()
    sizes = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(got) == len(sizes)
    for r in got:
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, [1.0] * 16), plain_shard(r.doc_id, [1.0] * 17))
        assert r.size == len((sizes[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((sizes[r.doc_id] or "").encode())
    for n in range(16):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))
    uneven = [0.5, 0.0, 3.0]
    some = sharding.shard_layout(docs_of(spark, ODD), uneven).collect()
    assert all(r.shard == plain_shard(r.doc_id, uneven) and r.grown_shard == plain_shard(r.doc_id, [*uneven, 1.0]) for r in some)


ODD = [(1, "é b", "x"), (1, "é b", "x"), (2, None, None), (None, "a", "y"), (None, "c", "y"), (3, "", "x"), (4, "w " * 50_000, "y")]


def test_shards(spark):
    rows = ODD + [(100 + i, f"t{i}", "z") for i in range(400)]
    got = sharding.shard_layout(docs_of(spark, rows), [1.0] * 16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    assert sum(r.grown_shard == 16 for r in got) > 5
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def test_shard_weights_and_columns(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("old").alias("shard"))
    n = Counter(r.shard for r in sharding.with_shards(docs, [1.0, 3.0, 0.0]).collect())
    assert set(n) == {0, 1} and abs(n[1] / 6000 - 0.75) < 0.03
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])
    assert sharding.shard_layout(docs_of(spark, []), [1.0]).count() == 0


def brute_targets(sizes, weights, most):
    left, open_, out = sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i % 37), "abcdefg"[min(6, i % 11)]) for i in range(900)] + [(2000 + i, "v " * 30, None) for i in range(5)] + ODD
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    want = dict(zip(order, brute_targets([sizes[s] for s in order], weights, 3), strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.source))
    assert sorted(map(key, got)) == sorted(map(key, again))


def brute_seats(targets, caps, total):
    """One block at a time to the highest quotient; the earlier source on equal ones."""
    won = [0] * len(targets)
    for _ in range(total):
        best = max((i for i in range(len(won)) if won[i] < caps[i]), key=lambda i: (targets[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("case", ["plain", "capped", "tiny", "equal"])
def test_seats_are_the_highest_quotients(spark, case):
    rng = random.Random(case)
    sizes = {"plain": [530, 240, 230], "capped": [3000, 1, 2, 900, 4], "tiny": [1] * 300 + [2000], "equal": [7] * 9}[case]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))] if case != "tiny" else [rng.random() for _ in sizes]
    targets, caps, total = brute_targets(sizes, weights, 3), [3 * n for n in sizes], sum(sizes)
    goals = spark.createDataFrame([(i, float(t), c, total) for i, (t, c) in enumerate(zip(targets, caps, strict=True))], "source_no int, target double, cap long, total long")
    won = mixing.seats(goals)
    assert [r.won for r in won.orderBy("source_no").collect()] == brute_seats(targets, caps, total)
    parts = mixing.quotas(won, shards=4).collect()
    by_shard, by_source = Counter(), Counter()
    for r in parts:
        by_shard[r.shard] += r.words
        by_source[r.source_no] += r.words
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert {r.source_no: r.won for r in won.collect() if r.won} == {s: n for s, n in by_source.items() if n}


def test_small_sources_and_caps_are_taken_to_the_word(spark, tmp_path):
    rows = [(i, "w " * 2500, "ab"[i % 2]) for i in range(120)] + [(200, "v " * 5, "c"), (201, "v " * 4, "d"), (202, "u " * 100, "e")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert [got[i].taken for i in (200, 201, 202)] == [15, 12, 300]
    assert Counter(r.doc_id for r in mixing.mixed(docs).where("doc_id >= 200").collect()) == {200: 3, 201: 3, 202: 3}
    assert sum(r.size - r.taken for r in got.values()) == 0
    assert all(r.taken == r.size for r in mixing.mix(docs, most=1).collect())
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(QUERIES["op4_mixing"][1])
    names = [d[0] for d in cur.description]
    want = {(r := dict(zip(names, row, strict=True)))["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for row in cur.fetchall()}
    assert {i: (r.size, r.source_size, r.target, r.taken) for i, r in got.items()} == want


def test_many_sources(spark):
    rows = [(i, "w " * (20 + i), f"s{i:02}") for i in range(40)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in got) and sum(r.taken for r in got) == sum(r.size for r in got)


def test_mixed_documents(spark):
    rows = [(i, "w " * 10, "a" if i < 90 else "b") for i in range(100)]
    shares = {r.doc_id: r.taken for r in mixing.mix(docs_of(spark, rows)).collect()}
    left = mixing.mixed(docs_of(spark, rows))
    assert left.columns == ["doc_id", "text", "source", "shard", "copies", "size"]
    assert Counter(r.doc_id for r in left.collect()) == Counter({i: n for i, t in shares.items() if (n := int(t / 10 + 0.5))})
    for empty in ([], [(1, None, "a"), (2, "", None)]):
        assert [r.taken for r in mixing.mix(docs_of(spark, empty)).collect()] == [0] * len(empty)
        assert mixing.mixed(docs_of(spark, empty)).count() == 0


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, width):
    out = []
    for i, t, _ in docs:
        w, hit, names = words(t), set(), []
        for name, text in items:
            x = words(text)
            k = min(width, len(x))
            windows = {tuple(x[s : s + k]) for s in range(len(x) - k + 1)} if x else set()
            at = [s for s in range(len(w) - k + 1) if tuple(w[s : s + k]) in windows] if windows else []
            hit |= {p for s in at for p in range(s, s + k)}
            names += [str(name)] if at else []
        out.append((i, len(w), len(hit), sorted(set(names))))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark):
    items = [(1, "the a b c d e f g h i j k l"), (2, "b c É é"), (3, None), (4, "..."), (5, "the the the the the the the the the the the the"), (6, "B, c É é!"), (7, "j k l")]
    items += [(5, "j k l"), (7, "J k l"), (7, "j k l"), (2, "b c É é")]  # repeated ids, with equal and other texts
    docs = [
        (1, "x the A-b c d, e f g h i j k l m", None), (2, "b c É é b c É é", None), (2, "the", None), (3, None, None), (4, "", None), (5, "the " * 60, None),
        (6, "a b c d e f g h i j k x l", None), (None, "j k l", None), (7, "q " * 3000 + "j k l " * 40, None), (7, "q " * 3000 + "j k l " * 40, None),
    ]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    got = decontaminate.contamination(docs_of(spark, docs), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute_hits(docs, items, 10)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    left = decontaminate.clean_documents(docs_of(spark, docs), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4] and left.columns == docs_of(spark, []).columns
    none = bench.limit(0)
    assert [r.n_hit for r in decontaminate.contamination(docs_of(spark, docs[:2]), none).collect()] == [0, 0]
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


def plain_near(text, item, slop, width=decontaminate.WIDTH):
    """Starts of the item's windows with every word at most `slop` words after its place, for some shift."""
    have, want = text.split(), item.split()
    width = min(width, len(want))
    reach = range(-len(want) - slop, len(have) + slop)
    near = lambda x, i: want[i] in have[max(x + i, 0) : max(x + i + slop + 1, 0)]
    return {s for s in range(len(want) - width + 1) if any(all(near(x, i) for i in range(s, s + width)) for x in reach)}


def test_proximity(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(14)]
    items = {1: "alpha beta gamma delta", 2: " ".join(base), 3: "one two one two one"}
    texts = {1: items[1], 2: "alpha x beta gamma delta", 3: "alpha x x x x x beta gamma delta", 4: "delta gamma beta alpha", 5: "alpha gamma delta", 7: "one two x one two one"}
    for d in range(10, 40):
        words = list(base) + ["one", "two"]
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([["x"], ["x", "x"], [rng.choice(base)], []])
        texts[d] = " ".join(words)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = docs_of(spark, [(d, x, None) for d, x in texts.items()] + [(6, None, None), (1, items[1], None)])
    index = decontaminate.build_index(docs, bench)
    for slop in (0, 1, 3, 9):
        found = decontaminate.near_matches(index, docs, slop).join(index.items, "seq").select("doc_id", "item_id", "start").collect()
        want = {(d, i, s) for d, x in texts.items() for i, item in items.items() for s in plain_near(x, item, slop)}
        assert len(found) == len(set(found)) and {tuple(r) for r in found} == want
    assert (5, 1, 0) not in want  # a word is missing


def test_full_texts_and_titles_are_known(spark):
    mit, bsd = licenses.TEXTS[0][1], next(t for i, t in licenses.TEXTS if i == "BSD-3-Clause")
    apache = (Path(licenses.__file__).with_name("license_files") / "Apache-2.0.txt").read_text()
    docs = [(1, f"The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n{mit}", None), (2, f"BSD 3-Clause License\n\n{bsd}", None), (3, apache.upper(), None), (4, "MIT License", None), (5, f"{mit} and more", None)]
    got = {r.doc_id: r.license_id for r in licenses.scan(docs_of(spark, docs), licenses.known(spark)).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: "Apache-2.0", 4: None, 5: None}
    own = spark.createDataFrame([("Own-1.0", "Do as you like.")], "license_id string, text string")
    more = licenses.known(spark, own).union(licenses.known(spark))
    assert [r.license_id for r in licenses.scan(docs_of(spark, [(1, "do as you like", None)]), more).collect()] == ["Own-1.0"]
    ids = {r.license_id for r in licenses.known(spark).collect()}
    assert ids >= {"GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"}


def test_licenses(spark):
    texts = [("L-1", "Permission to USE this\nlicence, for any purpose."), ("L-2", "Released under L."), ("L-0", "released UNDER l")]
    docs = [
        (1, "Copyright (c) 2020 Some One\nAll rights reserved.\n\npermission to use; this license for ANY purpose", None), (2, "text\nReleased under L.\n(c) 2021\nReleased -- under L", None),
        (3, None, None), (4, "", None), (4, "", None), (5, "permission to use this license for any purpose now", None), (2, "Released under L.", None), (6, "x " * 40_000, None),
    ]
    found = licenses.scan(docs_of(spark, docs), licenses.known(spark, texts)).collect()
    got = sorted((r.doc_id, r.license_id, r.n_license_lines, tuple(r.line_licenses)) for r in found if r.doc_id in (1, 5))
    assert got == [(1, "L-1", 1, ("L-1",)), (5, None, 0, ())]
    assert sorted((str(r.license_id), r.n_license_lines) for r in found if r.doc_id == 2) == [("L-0", 1), ("None", 2)]
    assert len(found) == len(docs) and not any(r.n_license_lines for r in found if r.doc_id in (3, 4, 6))
    assert licenses.scan(docs_of(spark, []), licenses.known(spark)).count() == 0
    assert licenses.scan(docs_of(spark, docs), licenses.known(spark, [])).where("license_id is not null").count() == 0
