"""Prefix trie of conversations from vertical bitmaps.

Conversations become paths of turn digests. Paths are sorted over the cluster, so the members of every
node follow each other, and each sorted partition is cut into shards of SHARD conversations. A shard is
an index (position, turn) -> bitset of its conversations; from the root down, the bitset of a node
and the posting of a turn give the bitset of a child, its number of members and the list of those that
end there. Only nodes on the first or the last path of a shard can go on in another one (`open`): their
pieces are added up, and sums over their subtrees are running sums along the sorted order, so no
pair of a node and its ancestors is ever made and a first turn that all share is spread over all shards.

A node is known by the digest of its path: 128 bits of SHA-256 per turn and for each path.

Defined cases: null turn numbers come first; equal turn numbers go by role, then by the digest of the turn, and
repeated rows are turns of their own; null role or text is empty; rows without conv_id belong to no
conversation; an empty table has no node; other columns are never read. A conversation's digests (16
bytes a turn, no text) are held by one task; so is a shard, of SHARD conversations.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poledger.plans.staging import settle

SHARD = 2048  # conversations in a shard, at most
HELD = 1 << 18  # turns after which a shard is closed too
WIDTH = 16  # bytes of a digest
EMPTY = hashlib.sha256(b"").hexdigest()

_SHARD_NODES = (
    "part int, shard int, open boolean, key binary, parent binary, depth long, n_convs long, conv_id long, parent_conv_id long, "
    "n_children long, n_leaves long, saved_tokens long, words long, first long, last long, ends_sha256 string, ends array<long>"
)


def paths(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (sorted array of turn, role, digest in hex, words)."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    framed = F.concat(F.length(by).cast("string"), F.lit(":"), by, said)
    turns = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), by.alias("role"), F.substring(F.sha2(framed.cast("binary"), 256), 1, 2 * WIDTH).alias("digest"),
            F.size(F.filter(F.split(said, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("words"),
        ).alias("said"),
    )
    # families of conversations with a common base meet in one partition, for the rebuilding below
    family = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).repartition("base")
    return family.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Every conversation with its first h turns taken from its base, h = crc32(conv_id) % 4."""
    base = convs.where("conv_id = base").select("base", F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = convs.join(base, "base", "left").withColumn("h", h)
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.expr("slice(head, 1, h)"))
    return joined.select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def _bits(b: int) -> Iterator[int]:
    while b:
        low = b & -b
        yield low.bit_length() - 1
        b ^= low


def _digest_chain(path: bytes) -> list[bytes]:
    """Digests of all prefixes of a path, the root first."""
    h = hashlib.sha256()
    out = [h.digest()[:WIDTH]]
    for at in range(0, len(path), WIDTH):
        h.update(path[at : at + WIDTH])
        out.append(h.digest()[:WIDTH])
    return out


def ends_digest(ids: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else EMPTY


def shard_nodes(ids: Sequence[int], trail: Sequence[bytes], words: Sequence[Sequence[int]], part: int, shard: int) -> list[dict]:
    """The nodes of one shard, whose conversations come sorted by (path, id). Counts of an open node
    are those of this shard, and its sums leave out the open nodes below it."""
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    over: dict[int, int] = defaultdict(int)  # length -> conversations that end there
    for i, path in enumerate(trail):
        for at in range(len(path) // WIDTH):
            postings[at, path[at * WIDTH : (at + 1) * WIDTH]] |= 1 << i
        over[len(path) // WIDTH] |= 1 << i
    edge = 1 | 1 << len(ids) - 1
    chains = {0: _digest_chain(trail[0]), len(ids) - 1: _digest_chain(trail[-1])}
    done: list[dict] = []

    def visit(bits: int, depth: int, parent: dict | None) -> list:
        ends = bits & over.get(depth, 0)
        lowest = (bits & -bits).bit_length() - 1
        node = {
            "part": part, "shard": shard, "open": bool(bits & edge), "depth": depth, "n_convs": bits.bit_count(), "n_children": 0, "n_leaves": 0,
            "saved_tokens": 0, "words": words[lowest][depth - 1] if depth else 0, "first": lowest, "last": bits.bit_length() - 1,
            "ends": [ids[i] for i in _bits(ends)],
        }
        node["conv_id"] = min(node["ends"], default=None)
        if node["open"]:
            chain = chains[0] if bits & 1 else chains[len(ids) - 1]
            node["key"], node["parent"] = chain[depth], chain[depth - 1] if depth else None
        elif parent["open"]:
            node["parent"] = parent["key"]
        return [node, parent, bits, bits & ~ends]

    stack = [visit((1 << len(ids)) - 1, 0, None)]
    while stack:
        node, parent, bits, left = frame = stack[-1]
        if left:
            at = (left & -left).bit_length() - 1
            depth = node["depth"]
            child = bits & postings[depth, trail[at][depth * WIDTH : (depth + 1) * WIDTH]]
            frame[3] = left & ~child
            stack.append(visit(child, depth + 1, node))
            continue
        stack.pop()
        done.append(node)
        if not node["open"]:
            node["n_leaves"] += node["n_children"] == 0
            node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
            node["ends_sha256"] = ends_digest(node["ends"])
            node["ends"] = None
        if parent is not None:
            parent["n_children"] += not node["open"]
            parent["n_leaves"] += node["n_leaves"] if not node["open"] else 0
            parent["saved_tokens"] += node["saved_tokens"] if not node["open"] else 0
            parent["conv_id"] = node["conv_id"] if parent["conv_id"] is None else min(parent["conv_id"], node["conv_id"])
            node["above"] = parent
    for node in done:
        above = node.pop("above", None)
        node["parent_conv_id"] = above["conv_id"] if above is not None and not above["open"] else None
    return done


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SHARD_NODES.split(", ")]
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[f.split()[1]] for f in _SHARD_NODES.split(", ")]
    part = TaskContext.get().partitionId()
    shard, ids, trail, words, held = 0, [], [], [], 0

    def closed():
        nodes = shard_nodes(ids, trail, words, part, shard)
        for at in range(0, len(nodes), 8192):
            some = nodes[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([n.get(k) for n in some], t) for k, t in zip(names, types, strict=True)], names=names)

    for b in batches:
        for i in range(b.num_rows):
            ids.append(b.column(0)[i].as_py())
            trail.append(b.column(1)[i].as_py())
            words.append(b.column(2)[i].values.to_numpy())
            held += len(words[-1])
            if len(ids) >= SHARD or held >= HELD:
                yield from closed()
                shard, ids, trail, words, held = shard + 1, [], [], [], 0
    if ids:
        yield from closed()


def local_nodes(convs: DataFrame) -> DataFrame:
    """Nodes of all shards, written once. convs: conv_id, turns (array of structs with digest and words)."""
    spark = convs.sparkSession
    keyed = convs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return settle(laid.select("conv_id", "path", "words").mapInArrow(_shards, _SHARD_NODES), "trie-shards")


def _ends(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the ends of open nodes. The lists of the shards follow each other in order of conv_id; the
    digest runs over them as a stream, so a task holds one list of one shard."""

    def run(batches):
        key, sha, some = None, None, False
        for b in batches:
            keys, digests = [], []
            for i in range(b.num_rows):
                k, ends = b.column(0)[i].as_py(), b.column(1)[i].values
                if k != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(sha.hexdigest())
                    key, sha, some = k, hashlib.sha256(), False
                if len(ends):
                    sha.update((("," if some else "") + ",".join(map(str, ends.to_pylist()))).encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    listed = pieces.where(F.size("ends") > 0).select("key", "ends", "part", "shard")
    laid = listed.repartition("key").sortWithinPartitions("key", "part", "shard").select("key", "ends")
    return laid.mapInArrow(run, "key binary, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """key and, for each name, the sum over the node and the open nodes below it. Nodes enter at their
    first member and leave at their last one; running sums between the two are those of the subtree. Each part's
    total is one row, so the only window without a key runs over as many rows as there are parts."""
    zero = [F.lit(0).cast("long").alias(n) for n in names]
    rank = lambda end: [F.col(f"{end}.part").alias("part"), F.col(f"{end}.shard").alias("shard"), F.col(f"{end}.at").alias("at")]
    enter = nodes.select("key", F.lit(0).alias("leaving"), F.col("depth").alias("order"), *rank("first"), *names)
    leave = nodes.select("key", F.lit(1).alias("leaving"), (-F.col("depth")).alias("order"), *rank("last"), *zero)
    events = enter.unionByName(leave)
    totals = events.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_base") for n in names])
    so_far = Window.partitionBy("part").orderBy("shard", "at", "leaving", "order").rowsBetween(Window.unboundedPreceding, 0)
    run = events.join(F.broadcast(base), "part").withColumns({f"{n}_run": F.col(f"{n}_base") + F.sum(n).over(so_far) for n in names})
    return run.groupBy("key").agg(*[F.sum(F.when(F.col("leaving") == 1, F.col(f"{n}_run")).otherwise(F.col(n) - F.col(f"{n}_run"))).alias(n) for n in names])


def _at(part: str, shard: str, at: str) -> Column:
    return F.struct(F.col(part).alias("part"), F.col(shard).alias("shard"), F.col(at).alias("at"))


def nodes_of(local: DataFrame) -> DataFrame:
    """The nodes of the whole trie from those of its shards."""
    pieces = local.where("open")
    merged = settle(
        pieces.groupBy("key").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.min(_at("part", "shard", "first")).alias("first"), F.max(_at("part", "shard", "last")).alias("last"),
        ),
        "trie-open",
    )
    below = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("open_children"))
    counted = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    valued = counted.withColumns({
        "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
    }).drop("open_children")
    sums = _subtree_sums(valued, ["n_leaves", "saved_tokens"])
    above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = (
        valued.drop("n_leaves", "saved_tokens").join(sums, "key").join(_ends(pieces), "key", "left").join(above, "parent", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    )
    inside = local.where("not open and parent is null")
    # the pieces of a node carry its smallest member back to their own shards, where its children are
    tops = local.where("not open and parent is not null").drop("parent_conv_id")
    told = pieces.select("part", "shard", F.col("key").alias("parent")).join(above, "parent")
    hung = tops.join(told, ["part", "shard", "parent"])
    return shared.select(*columns).unionByName(hung.select(*columns)).unionByName(inside.select(*columns))


def trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    return nodes_of(local_nodes(paths(rows, conv_id, turn, role, text)))


def rebuilt_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations with heads shared by twenty ids."""
    return nodes_of(local_nodes(with_shared_heads(paths(rows, conv_id, turn, role, text))))
