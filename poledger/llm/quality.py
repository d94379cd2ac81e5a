"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)); the last sum is
all pairwise interactions in time linear in the features of a document.

The model is learnt from at most SAMPLE labelled rows, chosen by a seeded hash of their ids, so its
cost does not grow with the corpus; every document is scored on its whole text.

Defined cases: null and empty texts have no words and are scored on structure alone; null or
missing metadata is a feature value of its own; labels that are null, not 0 or 1, or that disagree about a
document are not learnt from; repeated rows are scored alike; without both classes to learn from
the score is the share of label 1 (1/2 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000  # labelled rows that the model is learnt from, at most
BUCKETS = 1 << 12  # hashed words
BINS = 8  # quantile bins of a statistic
FACTORS = 4
ROUNDS = 80
THRESHOLD = 0.3
SEED = "quality"
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "stops", "beyond_ascii", "spaces", "lines",
    "line_length", "distinct", "top_word", "repeated_lines", "bare_lines", "no_letter_words", "echoes",
)

_KIND = np.full(256, 4)  # of a byte: 0 lower, 1 upper, 2 digit, 3 white space, 4 symbol, 5 beyond ASCII, 6 stop
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 10, 11, 12, 13, 32]], _KIND[128:] = 0, 1, 2, 3, 5
_KIND[[44, 46, 59, 58]] = 6
_CACHE = 200_000


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?\"'()").lower()) % BUCKETS
        return h


def statistics(text: bytes, words: list[bytes]) -> np.ndarray:
    """The structure of a text as numbers, in the order of STATISTICS."""
    size, n = max(1, len(text)), max(1, len(words))
    kind = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    times = Counter(words)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n,
        kind[1] / max(1e-9, kind[0] + kind[1] + kind[5]) if len(text) else 0, kind[2], kind[4], kind[6], kind[5], kind[3],
        np.log1p(len(lines)), np.log1p(size / max(1, len(lines))), len(times) / n, max(times.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
        sum(not any(65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in w[:3]) for w in words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ])


def word_features(words: list[bytes], buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their weights, of unit length."""
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    at, times = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    weight = np.sqrt(times)
    return at, weight / np.sqrt((weight**2).sum())


@dataclass(frozen=True)
class Machine:
    """edges: bins of each statistic and metadata column. Features: words, then bins, then missing."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def features(self, at, weight, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = BINS + 1
        bins = np.array([np.searchsorted(e, x, side="right") if x == x else BINS for e, x in zip(self.edges, numbers, strict=True)])
        return np.r_[at, BUCKETS + step * np.arange(len(numbers)) + bins], np.r_[weight, np.full(len(numbers), 0.5)]

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        z = self.bias + self.linear[at] @ x + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _rows(batches):
    for b in batches:
        ids, texts, rest = b.column(0), b.column(1), [b.column(i) for i in range(2, b.num_columns)]
        for i in range(b.num_rows):
            text = texts[i].as_py() or b""
            meta = [c[i].as_py() for c in rest]
            yield ids[i].as_py(), text, [float("nan") if m is None else float(m) for m in meta]


def _input(docs: DataFrame, doc_id: str, text: str, metadata: Sequence[str]) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), *[F.col(m).cast("double").alias(f"meta_{i}") for i, m in enumerate(metadata)])


def held_out(doc_id: str):
    """One row in five, by id alone."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, metadata: Sequence[str], label: str, sample: int):
    """Features of the learning sample; its size is bounded by `sample`."""
    clear = (
        labels.where(F.col(label).isin(0, 1)).where(~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("label_id")).agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other")
    )
    chosen = clear.orderBy(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("label_id").cast("string"))), "label_id").limit(sample).select("label_id", "y")
    rows = _input(docs, doc_id, text, metadata)
    # the sample is bounded, so it goes to the documents and not the documents to it
    picked = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["label_id"]).drop("label_id")
    picked = picked.select("doc_id", "text", *[f"meta_{i}" for i in range(len(metadata))], "y")

    def read(batches):
        buckets = _Buckets()
        for b in batches:
            for start in range(0, b.num_rows, 64):
                out = {"doc_id": [], "y": [], "at": [], "weight": [], "numbers": []}
                for doc, raw, numbers in _rows([b.slice(start, 64)]):
                    words = raw.split()
                    at, weight = word_features(words, buckets)
                    for name, value in zip(out, (doc, int(numbers[-1]), at, weight, np.r_[statistics(raw, words), numbers[:-1]]), strict=True):
                        out[name].append(value)
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return picked.mapInArrow(read, "doc_id long, y int, at array<int>, weight array<float>, numbers array<double>")


def learn(rows: Sequence[tuple[int, Sequence[int], Sequence[float], Sequence[float]]], statistics_: int) -> Machine:
    """rows: (label, word buckets, weights, numbers), in a fixed order."""
    y = np.array([r[0] for r in rows], float)
    numbers = np.array([r[3] for r in rows], float).reshape(len(rows), statistics_)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.array([np.quantile(c, quantiles) if len(c := col[col == col]) else np.zeros(BINS - 1) for col in numbers.T])
    size = BUCKETS + (BINS + 1) * statistics_
    prior = y.mean() if len(y) else 0.5
    rng = np.random.default_rng(7)
    # one row for each factor: a step then holds the entries of one factor at a time
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)).T.copy()
    if not rows or not 0 < prior < 1:
        return Machine(edges, 35.0 * (2 * prior - 1), w, np.zeros((size, FACTORS)))
    blank = Machine(edges, 0.0, w, v.T)
    feats = [blank.features(np.asarray(r[1], np.int64), np.asarray(r[2]), n) for r, n in zip(rows, numbers, strict=True)]
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in feats])
    col, x = np.concatenate([a for a, _ in feats]), np.concatenate([b for _, b in feats])
    del feats
    bias = np.log(prior / (1 - prior))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), w, v)]
    for step in range(1, ROUNDS + 1):
        total, square = np.empty((FACTORS, len(rows))), np.zeros(len(rows))
        for f in range(FACTORS):
            vx = v[f][col] * x
            total[f] = np.bincount(row, vx, len(rows))
            square += np.bincount(row, vx**2, len(rows))
        z = bias + np.bincount(row, w[col] * x, len(rows)) + 0.5 * ((total**2).sum(0) - square)
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(rows)
        gx = g[row] * x
        gw = np.bincount(col, gx, size) + 1e-5 * w
        gv = np.stack([np.bincount(col, gx * (total[f][row] - v[f][col] * x), size) for f in range(FACTORS)]) + 1e-5 * v
        moves = []
        for (m, s), grad in zip(state, (np.array([g.sum()]), gw, gv), strict=True):
            m[:] = 0.9 * m + 0.1 * grad
            s[:] = 0.99 * s + 0.01 * grad**2
            moves.append(0.08 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8))
        bias, w, v = bias - moves[0][0], w - moves[1], v - moves[2]
    return Machine(edges, float(bias), w, np.ascontiguousarray(v.T))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",),
    label: str = "quality", sample: int = SAMPLE,
) -> Machine:
    found = sample_features(docs, labels, doc_id, text, metadata, label, sample).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    cells = [[x.values.to_numpy() for x in found.column(c)] for c in ("at", "weight", "numbers")]
    return learn(list(zip(found.column("y").to_pylist(), *cells, strict=True)), len(STATISTICS) + len(metadata))


def scores(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def read(batches):
        buckets, m = _Buckets(), model.value
        for b in batches:
            out = []
            for _, raw, numbers in _rows([b]):
                words = raw.split()
                at, weight = word_features(words, buckets)
                out.append(m.score(*m.features(at, weight, np.r_[statistics(raw, words), numbers])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = _input(docs, doc_id, text, metadata).mapInArrow(read, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns. The decision is made where the
    row is, so no text is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    place, metas = docs.columns.index(text), [docs.columns.index(m) for m in metadata]

    def read(batches):
        buckets, m = _Buckets(), model.value
        for b in batches:
            texts = b.column(place).cast(pa.binary())
            stay = []
            for i in range(b.num_rows):
                raw = texts[i].as_py() or b""
                words = raw.split()
                meta = [float("nan") if (x := b.column(c)[i].as_py()) is None else float(x) for c in metas]
                stay.append(m.score(*m.features(*word_features(words, buckets), np.r_[statistics(raw, words), meta])) >= threshold)
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(read, docs.schema)
