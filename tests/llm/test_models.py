"""Whitening, the prefix trie and language identification against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from poledger.llm import language_id, prefix_trie, whitening
from poledger.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain_whitening(vectors):
    """{id: (deviation, projections on all components up to sign)}, variances, n."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    xs = {i: [int(np.floor(np.float64(c) * 256)) for c in v] + [0] * (width - len(v)) for i, v in kept}
    fit = sorted({tuple(x) for x in xs.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    _, sigma, w = np.linalg.svd(centred)
    e = np.r_[sigma, np.zeros(width - len(sigma))] ** 2 / n
    far = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in xs.items()}
    rows = {i: np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) for i, x in xs.items()}
    return far, rows, e, w, n


def check_whitening(df, vectors, components=4):
    far, rows, e, axes, n = plain_whitening(vectors)
    got = defaultdict(dict)
    for r in df.collect():
        got[r.vec_id][r.component] = r
    assert set(got) == set(far)
    k = min(components, int((e > 1e-24 * e[0]).sum()))
    sign = {}
    for i, parts in got.items():
        assert sorted(parts) == list(range(1, k + 1))
        for c, r in parts.items():
            want = rows[i] @ axes[c - 1] / np.sqrt(e[c - 1])
            if abs(want) > 1e-6:
                sign.setdefault(c, np.sign(r.whitened * want))
            assert abs(r.whitened * sign.get(c, 1) - want) < 1e-8 * max(1, abs(want))
            assert r.deviation == (far[i] if far[i] < 2**63 else None) and r.n == n
            assert abs(r.explained - e[c - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-8


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(QUERIES["op11_whitening"][0](spark, SF), [(r.vec_id, r.embedding) for r in rows])


def frame(spark, vectors):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], "a", 1) for i, v in vectors], "vec_id long, embedding array<double>, x string, component int")


@pytest.mark.parametrize("case", ["odd", "flat", "far", "stiff"])
def test_whitening_cases(spark, case):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 2, (40, 5)).tolist()
    vectors = list(enumerate(base))
    if case == "odd":
        vectors += [(100, None), (101, [1.0, None, 0, 0, 0]), (102, [float("nan")] * 5), (103, [float("inf"), 0, 0, 0, 0]), (104, [3.5, -2.0]), (105, [-0.001] * 5)]
        vectors += [(200 + i, base[0]) for i in range(60)]
    if case == "flat":  # dimensions that are sums or copies of others, and constant ones
        vectors = [(i, [v[0], v[1], v[0], 7.25, v[1] + 0.0, 0.0]) for i, v in vectors]
    if case == "far":
        vectors = [(i, [c * 3e12 for c in v]) for i, v in vectors]
    if case == "stiff":
        vectors = [(i, [c * 10.0 ** (4 - 2 * j) for j, c in enumerate(v)]) for i, v in vectors]
    check_whitening(whitening.whiten(frame(spark, vectors)), vectors, 4)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [2.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in one) == [("1", 1, 1.0, 1.0), ("None", 1, 1.0, 1.0)]


def test_factors_orthogonalise_at_any_condition():
    a = np.random.default_rng(0).normal(size=(50, 4)) * [1, 1e-3, 1e-9, 0]
    r = whitening._cholesky(a.T @ a, 1e-12)
    assert np.allclose(whitening.solved(a, r) @ r, a, atol=1e-12) and np.allclose(r, np.triu(r))


def plain_trie(rows, rebuild):
    by = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: -1 if r[1] is None else r[1]):
        by[c].append((role or "", text or ""))
    paths = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = by.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:] if rebuild else own
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p)))).encode()).hexdigest()
    return sorted(repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p))) for p, m in members.items())


def trie_rows(df):
    return sorted(repr((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in df.collect())


TALKS = [(c, t, ["user", "assistant", None][(c + t) % 3], ["a b", "", "c\n d e", None][(c * t) % 4]) for c in range(-45, 90) for t in range(abs(c) % 6)]
TALKS += [(c, t, "system", "same start") for c in range(100, 180) for t in range(1)] + [(c, 1, "user", f"q {c % 7}") for c in range(100, 180)]
TALKS += [(c, t, "user", "long " * (t % 5)) for c in (300, 301, 333) for t in range(400)]
TALKS += [(None, 0, "user", "no id"), (500, None, "user", "first"), (500, 0, "user", "second"), (501, 0, "user", "twice"), (501, 0, "user", "twice"), (502, 0, "us", "er"), (503, 0, "u", "ser")]


@pytest.mark.parametrize(("shard", "rebuild"), [(2048, True), (3, True), (3, False), (1, False)])
def test_trie_equals_the_plain_one(spark, monkeypatch, shard, rebuild):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = spark.createDataFrame([(*r, "x", 1, True) for r in TALKS], "conv_id long, turn long, role string, text string, base string, part int, open boolean")
    convs = prefix_trie.paths(rows)
    # the tasks import the module anew, so the size of a shard goes through the rows of one shard as well
    local = prefix_trie.local_nodes(prefix_trie.with_shared_heads(convs) if rebuild else convs)
    assert trie_rows(prefix_trie.nodes_of(local)) == plain_trie(TALKS, rebuild)


def test_trie_of_shards_of_any_size(spark):
    """Shards cut by hand: the pieces of open nodes add up."""
    rows = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string")
    whole = sorted(((r.conv_id, bytes.fromhex("".join(t.digest for t in r.turns)), [t.words for t in r.turns]) for r in prefix_trie.paths(rows).collect()), key=lambda r: (r[1], r[0]))
    names = [f.split()[0] for f in prefix_trie._SHARD_NODES.split(", ")]
    for step in (1, 2, 7):
        out, shards = [], [whole[i : i + step] for i in range(0, len(whole), step)]
        for i, some in enumerate(shards):
            nodes = prefix_trie.shard_nodes([s[0] for s in some], [s[1] for s in some], [s[2] for s in some], i // 3, i % 3)
            out += [tuple(int(v) if isinstance(v := n.get(k), np.integer) else v for k in names) for n in nodes]
        local = spark.createDataFrame(out, prefix_trie._SHARD_NODES)
        assert trie_rows(prefix_trie.nodes_of(local)) == plain_trie(TALKS, False)


def test_trie_of_nothing(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.rebuilt_trie(rows).count() == 0


def test_gradients_of_the_network():
    net = language_id.fresh_network(["a", "b", "c"], 3)
    net = language_id.Network(net.languages, *[w.astype(float) for w in net.weights()])
    rng = np.random.default_rng(0)
    text, inside = language_id.padded([bytes(rng.integers(0, 4, n).astype(np.uint8)) for n in (5, 7, 3)])
    target = np.array([0, 2, 1])
    _, found = language_id.gradients(net, text, inside, target)
    for w, g in zip(net.weights(), found, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, min(s, 4)) for s in w.shape)
            keep, losses = w[at], []
            for d in (1e-2, -1e-2):
                w[at] = keep + d
                losses.append(language_id.gradients(net, text, inside, target)[0])
            w[at] = keep
            assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 1e-4


def plain_network(net, text: bytes):
    """Probabilities of a text, byte by byte."""
    k, sums = net.hidden, np.zeros(len(net.languages))
    sig = lambda x: 1 / (1 + np.exp(-x))
    for start in range(0, len(text), language_id.STRETCH):
        part, states = text[start : start + language_id.STRETCH], []
        for side, seq in enumerate((part, part[::-1])):
            h, seen = np.zeros(k), []
            for byte in seq:
                a, u = net.table[side][:, byte].astype(float), net.state[side].astype(float) @ h
                z, r = sig(a[:k] + u[:k]), sig(a[k : 2 * k] + u[k : 2 * k])
                h = z * h + (1 - z) * np.tanh(a[2 * k :] + r * u[2 * k :])
                seen.append(h)
            states.append(seen)
        for fore, aft in zip(states[0], reversed(states[1]), strict=True):
            o = np.exp(net.out.astype(float) @ np.r_[fore, aft] + net.bias)
            sums += o / o.sum()
    return sums / max(1, len(text))


def test_scores_equal_a_loop_over_bytes(spark):
    net = language_id.fresh_network(["de", "en", "fr"], seed=5)
    texts = ["", None, "a", "ein Haus " * 40, "été " * 33, "123 ...", "x" * 64, "y" * 65, "日本語", "long " * 30_000]
    rows = [(i, t, "q", 1.0) for i, t in enumerate(texts)] + [(3, "ein Haus " * 40, "q", 1.0), (None, "no id", "q", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = [r for r in language_id.labelled(df, net).collect()]
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in [*enumerate(texts), (None, "no id")]:
        r = by[i]
        if not t or t == "123 ...":
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = plain_network(net, t.encode())
        assert r.lang_pred == net.languages[p.argmax()] and abs(r.score - p.max()) < 1e-4
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    cover = defaultdict(int)
    for r in language_id.spans(df, net).collect():
        cover[r.doc_id] += r.end - r.begin
    assert cover[4] == len(texts[4].encode()) and cover[9] == 150_000 and cover[3] == 2 * len(texts[3])


def test_languages_are_learnt(spark):
    got = QUERIES["op13_language_id"][0](spark, SF.replace("0.001", "0.01")).alias("g")
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_little_to_learn_from(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    for rows, want in (([], []), ([(1, "a", None, "z")], ["und"]), ([(1, "abc", "xx", "z"), (1, "abc", "xx", "z"), (4, "?", "yy", "z")], ["und", "xx", "xx"])):
        df = spark.createDataFrame(rows, schema)
        assert sorted(r.lang_pred for r in language_id.labelled(df, language_id.fit(df)).collect()) == want
