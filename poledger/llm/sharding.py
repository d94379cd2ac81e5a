"""Sharding by rendezvous hashing.

Every (key, shard) pair has a score from a hash of both and the shard's weight; a row goes to its
best shard. A new shard changes no score of the others, so it takes rows only into itself.

Defined cases: rows with one key share a shard; a null key is a key of its own; a null text has no
bytes; equal scores go to the lower shard; an empty table gives an empty result; an input column
named like an output column is replaced in `with_shards`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poledger.llm.numbering import seeded, starts
from poledger.plans.staging import settle

SEED = "shards"


def rendezvous(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The shard (0 to len(weights) - 1) that a key goes to; a shard of weight 0 gets nothing."""
    known = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError(f"shard {shard} has weight {weight}")
        if weight:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{shard}"), known), 11)
            even = (bits.cast("double") + 0.5) / float(2**53)
            scores.append(F.struct((-F.lit(float(weight)) / F.log(even)).alias("score"), F.lit(-shard).alias("shard")))
    if not scores:
        raise ValueError("no shard has a weight")
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def with_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """All rows and columns, and the shard of each."""
    return docs.withColumn("shard", rendezvous(F.col(key), weights))


def shard_layout(docs: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: where it goes, its place in the shard, and where it would go with one
    more shard of weight 1."""
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            rendezvous(F.col(doc_id), weights).alias("shard"),
            rendezvous(F.col(doc_id), [*weights, 1.0]).alias("grown_shard"),
        ),
        "shards",
    ).withColumn("order", seeded("slots", F.col("doc_id")))
    numbered = starts(rows, "shard", "order", F.lit(1), ["text_crc32", "size"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
