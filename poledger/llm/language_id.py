"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a stretch of STRETCH bytes, one from each end; at every byte their states
together give a probability of each language. A document's probabilities are the means over all its bytes, and
its language is the likeliest. A text of any length is cut into stretches that are read side by side, so no byte is
left out and a task holds one block of them. The network is learnt in numpy by backpropagation through time from a
bounded sample: at most SAMPLE documents, dealt evenly over their languages in a seeded order, and at most
PIECES stretches of each at seeded places.

Update of a state h at byte x: z, r = sigmoid(W x + U h), c = tanh(W x + r * (U h)), h' = z h + (1 - z) c.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text when nothing can be learnt;
null languages are not learnt from; a document that occurs with several languages or texts is learnt from by the smallest
of them; with one language every text with a letter has it; repeated rows are labelled alike; a null
doc_id is kept and counts as not held out, but is not learnt from; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 2000  # documents that the network is learnt from, at most
PIECES = 4  # stretches of a document that are learnt from, at most
STRETCH = 64  # bytes that a recurrence runs over
HIDDEN = 8
BATCH = 128
ROUNDS = 12
BLOCK = 1024  # stretches read side by side
UNKNOWN = "und"
SEED = "language"


@dataclass(frozen=True)
class Network:
    """table: input weights and biases of the 256 bytes; state: recurrent weights; the first axis is the
    direction, the second has the update gate, the reset gate and the candidate, HIDDEN rows each."""

    languages: list[str]
    table: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.state.shape[2]

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.state, self.out, self.bias]


def fresh_network(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32)
    table[:, :hidden] += 1.0  # keeps states for some bytes at the start
    state = rng.normal(0, 0.5 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32)
    out = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
    return Network(languages, table, state, out, np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def run(net: Network, text: np.ndarray, inside: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
    """States (2 * hidden, T, B) of both directions at each byte. text: bytes (T, B); inside: 1 where a
    stretch has a byte, for stretches that are shorter; trace takes what the way back needs."""
    steps, width = text.shape
    k = net.hidden
    states = np.empty((2, k, steps, width), np.float32)
    h = np.zeros((2, k, width), np.float32)
    gates = np.empty((2, 3 * k, width), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        np.take(net.table[0], text[t], axis=1, out=gates[0], mode="clip")
        np.take(net.table[1], text[back], axis=1, out=gates[1], mode="clip")
        inner = np.matmul(net.state, h)
        zr = _sigmoid(gates[:, : 2 * k] + inner[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        u = inner[:, 2 * k :]
        c = np.tanh(gates[:, 2 * k :] + r * u)
        new = c + z * (h - c)
        m = None
        if inside is not None:
            m = np.stack([inside[t], inside[back]])[:, None, :]
            new = h + m * (new - h)
        if trace is not None:
            trace.append((h, z, r, u, c, m))
        h = new
        states[0, :, t], states[1, :, back] = h[0], h[1]
    return states.reshape(2 * k, steps, width)


def probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """Probability of each language at each byte: (languages, T, B)."""
    _, steps, width = states.shape
    p = net.out @ states.reshape(len(states), -1) + net.bias[:, None]
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p.reshape(-1, steps, width)


def gradients(net: Network, text: np.ndarray, inside: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all bytes and its gradients. target: language of each stretch."""
    steps, width = text.shape
    k, trace = net.hidden, []
    states = run(net, text, inside, trace)
    p = probabilities(net, states)
    share = inside / inside.sum()
    loss = -float((np.log(np.maximum(np.take_along_axis(p, target[None, None, :], 0)[0], 1e-12)) * share).sum())
    d = p
    d[target, :, np.arange(width)] -= 1
    d *= share
    flat = d.reshape(len(d), -1)
    g_out, g_bias = flat @ states.reshape(2 * k, -1).T, flat.sum(1)
    d_states = (net.out.T @ flat).reshape(2, k, steps, width)
    g_state, carried = np.zeros_like(net.state), np.zeros((2, k, width), np.float32)
    on_input = np.empty((2, 3 * k, steps, width), np.float32)
    for t in reversed(range(steps)):
        h, z, r, u, c, m = trace[t]
        back = steps - 1 - t
        dh = carried + np.stack([d_states[0, :, t], d_states[1, :, back]])
        dn = dh * m
        dc = dn * (1 - z) * (1 - c * c)
        dz, dr = dn * (h - c) * z * (1 - z), dc * u * r * (1 - r)
        inner = np.concatenate([dz, dr, dc * r], 1)
        carried = dh - dn + dn * z + np.matmul(net.state.transpose(0, 2, 1), inner)
        g_state += np.matmul(inner, h.transpose(0, 2, 1))
        at_input = np.concatenate([dz, dr, dc], 1)
        on_input[0, :, t], on_input[1, :, back] = at_input[0], at_input[1]
    flat_text = text.ravel()
    rows = on_input.reshape(6 * k, -1)
    g_table = np.stack([np.bincount(flat_text, row, 256) for row in rows]).reshape(net.table.shape)
    return loss, [g_table, g_state, g_out, g_bias]


def padded(pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask, (T, B)."""
    steps = max(1, max(map(len, pieces), default=1))
    text, inside = np.zeros((len(pieces), steps), np.uint8), np.zeros((len(pieces), steps), np.float32)
    for i, p in enumerate(pieces):
        text[i, : len(p)], inside[i, : len(p)] = np.frombuffer(p, np.uint8), 1
    return np.ascontiguousarray(text.T), np.ascontiguousarray(inside.T)


def learn(pieces: Sequence[tuple[str, bytes]], hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = 0.02) -> Network:
    """pieces: (language, bytes), in a fixed order."""
    languages = sorted({p[0] for p in pieces})
    net = fresh_network(languages, hidden)
    if len(languages) < 2:
        return net
    number = {name: i for i, name in enumerate(languages)}
    text, inside = padded([p[1] for p in pieces])
    target = np.array([number[p[0]] for p in pieces])
    rng = np.random.default_rng(11)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in net.weights()]
    total, step = rounds * -(-len(pieces) // BATCH), 0
    for _ in range(rounds):
        order = rng.permutation(len(pieces))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            _, grads = gradients(net, text[:, some], inside[:, some], target[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            pace = rate * (1 - step / (total + 1))
            for w, (m, s), g in zip(net.weights(), moments, grads, strict=True):
                g = g / max(1.0, norm)
                m[:] = 0.9 * m + 0.1 * g
                s[:] = 0.99 * s + 0.01 * g * g
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def stretches(begin: np.ndarray, end: np.ndarray, step: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and length of every stretch of texts that lie at begin .. end in one buffer."""
    counts = -(-(end - begin) // step)
    of = np.repeat(np.arange(len(begin)), counts)
    at = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return of, at, np.minimum(step, end[of] - at)


def read_bytes(net: Network, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, place, length, probabilities (languages, T, B)) over all stretches."""
    of, at, size = stretches(begin, end)
    for some in (np.flatnonzero(size == STRETCH), (short := np.flatnonzero(size < STRETCH))[np.argsort(size[short], kind="stable")]):
        for start in range(0, len(some), BLOCK):
            now = some[start : start + BLOCK]
            steps = int(size[now].max())
            spot = np.arange(steps)[:, None]
            inside = None if size[now].min() == steps else (spot < size[now]).astype(np.float32)
            text = data[np.minimum(at[now] + spot, len(data) - 1)]
            yield of[now], at[now], size[now], probabilities(net, run(net, text, inside))


def pooled(net: Network, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean probabilities over the bytes of each text: (texts, languages)."""
    sums = np.zeros((len(begin), len(net.languages)))
    for of, _, size, p in read_bytes(net, data, begin, end):
        if size.min() < p.shape[1]:
            p = p * (np.arange(p.shape[1])[:, None] < size)
        for language, share in enumerate(p.sum(1)):
            sums[:, language] += np.bincount(of, share, len(begin))
    return sums / np.maximum(1, end - begin)[:, None]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins and ends, without a copy."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"\0", np.uint8)
    return data if len(data) else np.zeros(1, np.uint8), offsets[:-1], offsets[1:]


def held_out(doc_id: str) -> Column:
    """One row in four, by id alone."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network:
    """The network, learnt on the driver; its sample is bounded by `sample` documents, whatever the corpus."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id") & has_letter("text"))
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")))
    # counts of hash ranges tell which of them hold the first rows of a language, so only those are ranked
    rows = known.select("doc_id", "lang", order.alias("order"), F.substring(order, 1, 3).alias("bucket"))
    sooner = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(sooner), F.lit(0)))
    place = Window.partitionBy("lang").orderBy("order", "doc_id")
    early = rows.join(ahead.where(F.col("ahead") < sample), ["lang", "bucket"], "left_semi")
    ranked = early.withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample)
    chosen = ranked.orderBy("place", "lang", "doc_id").limit(sample).select(F.col("doc_id").alias("chosen_id")).distinct()
    # the sample is bounded, so its ids go to the documents; copies of one id fold before the shuffle
    texts = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one"))

    def cut(batches):
        for b in batches:
            ids, langs, raw = b.column(0), b.column(1), b.column(2)
            out = {"doc_id": [], "piece": [], "lang": [], "bytes": []}
            for i in range(b.num_rows):
                whole = raw[i].as_py()
                rng = np.random.default_rng(zlib.crc32(str(ids[i].as_py()).encode()))
                count = min(PIECES, -(-len(whole) // STRETCH))
                for n, at in enumerate(sorted(rng.integers(0, max(1, len(whole) - STRETCH + 1), count))):
                    for name, value in zip(out, (str(ids[i].as_py()), n, langs[i].as_py(), whole[at : at + STRETCH]), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=list(out))

    pieces = texts.select("doc_id", "one.lang", F.col("one.text").cast("binary").alias("text")).mapInArrow(cut, "doc_id string, piece int, lang string, bytes binary")
    rows = pieces.toArrow().sort_by([("doc_id", "ascending"), ("piece", "ascending")])
    return learn(list(zip(rows.column("lang").to_pylist(), rows.column("bytes").to_pylist(), strict=True)))


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), has_letter(text).alias("letters"))


def labelled(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def read(batches):
        m = model.value
        for b in batches:
            use = b.column(2).to_numpy(zero_copy_only=False) if m.languages else np.zeros(b.num_rows, bool)
            data, begin, end = _buffer(b.column(1))
            p = pooled(m, data, begin, np.where(use, end, begin)) if m.languages else np.zeros((b.num_rows, 1))
            best = p.argmax(1)
            names = [m.languages[k] if u else UNKNOWN for k, u in zip(best, use, strict=True)]
            score = np.where(use, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.select(F.col(doc_id).alias("d")).schema["d"].dataType.simpleString()
    found = _input(docs, doc_id, text).mapInArrow(read, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def spans(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of bytes with one label: doc_id, begin, end (in bytes of the UTF-8 text), lang. A run ends
    with its block of stretches at the latest."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.select(F.col(doc_id).alias("d")).schema["d"].dataType.simpleString()

    def read(batches):
        m = model.value
        for b in batches:
            data, begin, end = _buffer(b.column(1))
            for of, at, size, p in read_bytes(m, data, begin, end) if m.languages else ():
                best = p.argmax(0)
                there = np.arange(len(best))[:, None] < size
                change = np.vstack([np.ones((1, best.shape[1]), bool), best[1:] != best[:-1]]) & there
                column, row = np.nonzero(change.T)
                stop = np.r_[row[1:], 0]
                last = np.r_[column[1:] != column[:-1], True]
                stop = np.where(last, size[column], stop)
                place = at[column] - begin[of[column]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(of[column])), pa.array(place + row), pa.array(place + stop), pa.array([m.languages[k] for k in best[row, column]], pa.string())],
                    names=["doc_id", "begin", "end", "lang"],
                )

    return _input(docs, doc_id, text).mapInArrow(read, f"doc_id {kind}, begin long, end long, lang string")
