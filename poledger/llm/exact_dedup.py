"""Exact dedup by a heavy-hitter split.

A Misra-Gries pass finds digests that may be frequent. Their exact counts and winners fit in a
bounded table that is broadcast, so frequent copies are settled where they are read. All other
digests meet in an ordinary shuffle, whose groups are small by construction.

Defined cases: a null text counts as empty; texts are equal when they agree after each run of
ASCII white space becomes one space; of rows with equal doc_id the first one read stays; rows
without doc_id come after all others; an empty table gives an empty result; other columns of the
input are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poledger.llm.names import fresh
from poledger.plans.staging import settle

#: A digest is frequent when it holds more than this share of all rows; 1 / SUPPORT winners at most.
SUPPORT = 1 / 2000


def digest(text: str) -> Column:
    """Lower-case hex SHA-256 of the text with white space collapsed."""
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(flat.cast("binary"), 256)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(F.min("place").alias("winner"), F.count("*").alias("group_size"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id (the row that stays), group_size, kept, text_sha256."""
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            digest(text).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    ).withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    least = support * rows.count()
    maybe = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = settle(
        _groups(rows.join(F.broadcast(maybe), "text_sha256", "left_semi")).where(F.col("group_size") > least), "winners"
    )
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    frequent = marked.where(F.col("winner").isNotNull())
    rare = marked.where(F.col("winner").isNull()).drop("winner", "group_size")
    settled = frequent.unionByName(rare.join(_groups(rare), "text_sha256"))
    return settled.select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("winner.row_no") == F.col("row_no")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Repeats of one row (same doc_id, same
    text) stay once, the smallest by JSON."""
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    own_sha = fresh(docs, "own_sha")
    own = docs.withColumn(own_sha, digest(text))
    stay = own.join(kept, own[doc_id].eqNullSafe(kept["kept_id"]) & (own[own_sha] == kept["kept_sha"]), "left_semi")
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    first = stay.groupBy(F.col(doc_id).alias("id"), F.col(own_sha).alias("sha")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return first.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
