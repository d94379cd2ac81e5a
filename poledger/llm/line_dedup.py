"""Line dedup by pairwise alignment.

Pairs: from each line and up to each line, the shortest stretch of enough words has a hash, so a rare
line stands for itself and a common one with its neighbours. The n-th time a hash stands in a document it meets the
first document that has it n times (its owner), so a stretch that a third of all documents share gives as
many pairs as documents, never all pairs. Hashes have 128 bits.
Each pair is aligned by patience diff: shared stretches are anchors that both sides have once (repeats are
numbered), their longest rising run fixes the order, and runs of matched lines that follow each other in both are the common
blocks; blocks of enough words go from the later document. A stretch that crosses the order stays; those that
stay look for an owner again among the documents where they stay, until no pair is left.

Defined cases: documents are ordered by (doc_id, hash of the text), documents without doc_id last;
rows equal in both are one document, answered alike; null texts have no lines; blank lines stay and
part no block; a text of only common blocks keeps its blank lines, or nothing; an empty table gives
an empty result; other columns are kept by `without_copies` and not read.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poledger.plans.staging import settle

LEAST_WORDS = 10  # of a common block

_BASE = 0x9E3779B97F4A7C15  # of window keys; odd, so it has an inverse

_WINDOWS = "doc_id long, sum long, first int, stop int, key long, check long"
_SPANS = "doc_id long, sum long, first int, stop int, key long, check long, matched boolean"
_FOUND = "doc_id long, sum long, gone array<int>, gone_words long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(lines: str, seed: str) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.lit(seed), x))


def rising(pairs: list[tuple]) -> list[tuple]:
    """The longest run of pairs that rises in both places; pairs come in order of the first."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(pairs):
        k = bisect_left(tops, p[1])
        tops[k:k + 1], at[k:k + 1] = [p[1]], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(shared: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Patience diff. `shared`: for each common line its places in the later and the earlier
    document. Pairs of places that are matched, in order."""
    once = sorted((a[0], b[0]) for a, b in shared if len(a) == 1 and len(b) == 1)
    rest = [(sorted(a), sorted(b)) for a, b in shared if len(a) > 1 or len(b) > 1]
    out, before = [], (-1, -1)
    for anchor in [*rising(once), (float("inf"), float("inf"))]:
        gap = []
        for places in rest:
            inside = ([x for x in places[k][bisect_left(places[k], before[k] + 1):] if x < anchor[k]] for k in (0, 1))
            gap += zip(*inside, strict=False)
        out += rising(sorted(gap))
        out.append(anchor)
        before = anchor
    return out[:-1]


def blocks(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of matched lines that follow each other in both documents."""
    out: list[list[tuple[int, int]]] = []
    for p in pairs:
        if out and out[-1][-1] == (p[0] - 1, p[1] - 1):
            out[-1].append(p)
        else:
            out.append([p])
    return out


def windows(words: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The windows of documents whose lines stand one after another, `sizes` lines each: first
    line, line after the last, and two keys, which depend on the lines and the repeat only."""
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = begin + np.repeat(sizes, sizes)
    before = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(words))
    stop = np.searchsorted(before, before[:-1] + least)  # of the shortest from each line
    first = np.searchsorted(before, before[1:] - least, "right") - 1  # of the shortest up to each line
    on, back = stop <= end, first >= begin
    both = np.unique(np.concatenate((np.stack((at[on], stop[on]), 1), np.stack((first[back], at[back] + 1), 1))), axis=0)
    first, stop = both[:, 0], both[:, 1]
    power = np.full(len(words), _BASE, np.uint64).cumprod(dtype=np.uint64)
    shift = np.full(len(words), pow(_BASE, -1, 2**64), np.uint64).cumprod(dtype=np.uint64)
    keys = []
    for column in hashes:
        sums = np.concatenate((np.zeros(1, np.uint64), (column.view(np.uint64) * power).cumsum(dtype=np.uint64)))
        keys.append((sums[stop] - sums[first]) * shift[first] + (stop - first).astype(np.uint64))
    # the n-th time in its document
    doc = np.searchsorted(np.cumsum(sizes), first, "right")
    order = np.lexsort((first, keys[1], keys[0], doc))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in (doc, *keys)], axis=0)
    at = np.arange(len(order))
    times = np.empty(len(order), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return first, stop, (keys[0] + times * np.uint64(_BASE)).view(np.int64), keys[1].view(np.int64)


def pair_spans(first: np.ndarray, stop: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which stretches first .. stop of a later document, found at `other` in an earlier one, a
    patience diff of the two matches. Stretches come in order of (first, other)."""
    head = np.r_[True, first[1:] != first[:-1]]
    a, b = first[head], other[head]
    if (np.diff(b) <= 0).any():
        run = aligned([([x], [y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        a, b = np.array(run).T
    return b[np.minimum(np.searchsorted(a, first), len(a) - 1)] == other if len(a) else head


def _matched(found: DataFrame) -> DataFrame:
    """Aligns every document with the owners of its windows: the blocks to go (matched), and the
    windows that crossed the order of their pair and are not inside a block."""
    whole = found.withColumn("doc", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sum"))
    owners = whole.groupBy("key", "check").agg(F.min(F.struct("doc", "first")).alias("owner"), F.max("doc").alias("last")).where("owner.doc < last")
    met = whole.join(owners.select("key", "check", "owner"), ["key", "check"]).where("doc <> owner.doc")
    # rows equal in doc_id and text give each window twice: the windows of a document are a set
    owner = [F.col("owner.doc.doc_id").alias("owner_id"), F.col("owner.doc.sum").alias("owner_sum"), "first", F.col("owner.first").alias("other")]
    pairs = met.groupBy("doc_id", "sum").agg(F.collect_set(F.struct(*owner, "stop", "key", "check")).alias("pairs"))

    def align(batches):
        for b in batches:
            for i in range(b.num_rows):
                cells = b.column(2)[i].values
                # a null owner has a sum of its own, so its id may be read as 0
                columns = [cells.field(k).fill_null(0).to_numpy() for k in range(7)]
                order = np.lexsort(columns[3::-1])
                owner_id, owner_sum, first, other, stop, key, check = (c[order] for c in columns)
                cut = np.flatnonzero(np.r_[True, (owner_id[1:] != owner_id[:-1]) | (owner_sum[1:] != owner_sum[:-1]), True])
                matched = np.concatenate([pair_spans(first[x:y], stop[x:y], other[x:y]) for x, y in zip(cut, cut[1:], strict=False)])
                edge = np.bincount(first[matched], minlength=stop.max() + 1) - np.bincount(stop[matched], minlength=stop.max() + 1)
                gone = np.cumsum(edge) > 0
                ends = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                kept = np.r_[0, np.cumsum(~gone)]
                left = ~matched & (kept[stop] > kept[first])
                blocks, n = len(ends) // 2, len(ends) // 2 + int(left.sum())
                none = np.zeros(blocks, np.int64)
                of = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), b.column(1).take(of), pa.array(np.r_[ends[::2], first[left]], pa.int32()), pa.array(np.r_[ends[1::2], stop[left]], pa.int32()),
                     pa.array(np.r_[none, key[left]]), pa.array(np.r_[none, check[left]]), pa.array(np.arange(n) < blocks)],
                    names=["doc_id", "sum", "first", "stop", "key", "check", "matched"],
                )

    return pairs.mapInArrow(align, _SPANS)


def removals(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sum, gone, gone_words): line numbers (from 0) that go from each later document."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("sum"), lines_of(F.col(text)).alias("lines"))
    count = F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    hashed = [_hashes("lines", seed).alias(seed) for seed in ("line", "check")]
    forms = settle(own.select("doc_id", "sum", count.alias("words"), *hashed), "lines")
    least = max(1, least_words)

    def cut(batches):
        for b in batches:
            words = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            filled = words > 0  # blank lines part no block
            sizes = np.bincount(row[filled], minlength=b.num_rows)
            hashes = tuple(b.column(c).flatten().to_numpy(zero_copy_only=False)[filled] for c in (3, 4))
            first, stop, *keys = windows(words[filled], hashes, sizes, least)
            begin, doc = np.cumsum(sizes) - sizes, row[filled][first]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(first - begin[doc], pa.int32()), pa.array(stop - begin[doc], pa.int32()), *map(pa.array, keys)],
                names=["doc_id", "sum", "first", "stop", "key", "check"],
            )

    def fill(batches):
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "sum": [], "gone": [], "gone_words": []}
            for i in range(b.num_rows):
                words = np.array(b.column(2)[i].as_py())
                raw = np.flatnonzero(words)
                spans = b.column(3)[i].values
                edge = np.bincount(spans.field(0).to_numpy(), minlength=len(raw) + 1) - np.bincount(spans.field(1).to_numpy(), minlength=len(raw) + 1)
                gone = raw[np.cumsum(edge[:-1]) > 0]
                for name, value in zip(out, (b.column(0)[i].as_py(), b.column(1)[i].as_py(), gone, int(words[gone].sum())), strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    spans, now = [], forms.mapInArrow(cut, _WINDOWS)
    while True:
        after = settle(_matched(now), "aligned")
        spans.append(after.where("matched"))
        now = after.where("not matched").drop("matched")
        if now.isEmpty():
            break
    taken = reduce(DataFrame.unionByName, spans).groupBy("doc_id", "sum").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    later = taken.select(F.struct("doc_id", "sum").alias("doc"), "spans")
    one = forms.groupBy("doc_id", "sum").agg(F.first("words").alias("words"))
    met = one.join(later, one["doc_id"].eqNullSafe(later["doc.doc_id"]) & (one["sum"] == later["doc.sum"]))
    return met.select(one["doc_id"], one["sum"], "words", "spans").mapInArrow(fill, _FOUND)


def _joined(docs: DataFrame, least_words: int, doc_id: str, text: str) -> tuple[DataFrame, Column, DataFrame]:
    found = settle(removals(docs, least_words, doc_id, text), "removals").select(F.col("doc_id").alias("gone_doc"), F.col("sum").alias("gone_sum"), "gone", "gone_words")
    met = docs.join(found, docs[doc_id].eqNullSafe(found["gone_doc"]) & (F.xxhash64(docs[text]) == found["gone_sum"]), "left")
    stays = F.filter(lines_of(docs[text]), lambda x, i: ~F.array_contains(found["gone"], i))
    return met, F.when(found["gone"].isNull(), docs[text]).otherwise(F.array_join(stays, "\n")), found


def without_copies(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents with all columns; texts without the blocks that an earlier document has."""
    met, cleaned, _ = _joined(docs, least_words, doc_id, text)
    return met.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns])


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_gone, gone_words, text_sha256 (of what stays)."""
    met, cleaned, found = _joined(docs, least_words, doc_id, text)
    return met.select(
        docs[doc_id].alias("doc_id"), F.size(lines_of(docs[text])).cast("long").alias("n_lines"),
        F.when(found["gone"].isNull(), 0).otherwise(F.size(found["gone"])).cast("long").alias("n_gone"),
        F.coalesce(found["gone_words"], F.lit(0)).cast("long").alias("gone_words"), F.sha2(F.coalesce(cleaned, F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
