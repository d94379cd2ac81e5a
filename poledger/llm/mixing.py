"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources share all words by weight; none gets more than `most` times its own size, and what
is cut off goes to the others by weight. The mix has as many equal blocks as there are words, of one word
each, so that no source is too small for them; they go one by one to the source with the highest quotient
target / (2k + 1), where k counts the blocks it has, up to its cap. Most of a source's blocks are certain
from its target alone, so only those near the last quotient are listed and ranked: a few for each
source, whatever the number of words. Blocks deal into shards in turn, which gives each shard an integer quota
of each source.
Which words fill the blocks: the documents of a source stand in a seeded order, and its blocks take
that stream from its start, starting over at its end.

Defined cases: a null text has no words; a null source is a source of its own, the last in order;
documents without words take nothing; a table without words has targets and shares of 0; equal
quotients go to the earlier source; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poledger.llm.names import fresh
from poledger.llm.numbering import seeded, starts
from poledger.plans.staging import settle

WEIGHTS = (5, 2, 1)  # by order of source, repeating
MOST = 3  # times that a document may be taken
SHARDS = 16
SEED = "mix"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """The rows of the mix, without their texts."""
    return settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            words(text).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            seeded(seed, F.col(doc_id)).alias("order"),
        ),
        "sizes",
    )


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_no, source, source_size, target, total (of all sources)."""
    by_name, by_room, everything = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("room", "source_no"), Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("source_no") % len(weights)))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left") / F.col("open") >= F.col("room"))
        .withColumn("spare", F.col("total") - F.sum(F.expr("if(full, cap, 0)")).over(everything))
        .withColumn("sharing", F.sum(F.expr("if(full, 0.0D, weight)")).over(everything))
        .withColumn("target", F.expr("if(full, cast(cap as double), spare * weight / sharing)"))
        .select("source_no", "source", "source_size", "target", "cap", "total")
    )


def seats(goals: DataFrame) -> DataFrame:
    """One row per source: source_no, target, won (its blocks, which are words).

    With k sources, N words and N' of them in sources below their cap, the last quotient is 1 - or +
    k / 2N' at most, so blocks further than that (here four times as far, and two more) from a target are
    certainly won or certainly not."""
    whole = Window.partitionBy()
    bounds = (
        goals.withColumn("sources", F.count("*").over(whole))
        .withColumn("open", F.sum(F.expr("if(target < cap, target, 0.0D)")).over(whole))
        .withColumn("sure", F.expr("greatest(0L, cast(floor(target * (1 - 2.0D * sources / greatest(total, 1L))) as long) - 2)"))
        .withColumn("most", F.expr("least(cap, cast(ceil(target * (1 + 2.0D * sources / greatest(open, 1.0D))) as long) + 2)"))
        .withColumn("left", F.col("total") - F.sum("sure").over(whole))
    )
    each = bounds.where("most > sure").withColumn("nth", F.explode(F.expr("sequence(sure, most - 1)")))
    best = Window.orderBy(F.desc("quotient"), "source_no", "nth")
    ranked = each.withColumn("quotient", F.col("target") / (2 * F.col("nth") + 1)).withColumn("rank", F.row_number().over(best))
    near = ranked.where(F.col("rank") <= F.col("left")).groupBy("source_no").agg(F.count("*").alias("near"))
    return bounds.join(near, "source_no", "left").select("source_no", "target", (F.col("sure") + F.coalesce("near", F.lit(0))).alias("won"))


def quotas(won: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Integer quotas: source_no, shard, words. Blocks in order of sources deal into shards in turn."""
    by_no = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = won.withColumn("stop", F.sum("won").over(by_no)).withColumn("start", F.col("stop") - F.col("won"))
    each = placed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return each.select("source_no", "shard", F.expr(f"(stop - shard + {shards - 1}) div {shards} - (start - shard + {shards - 1}) div {shards}").alias("words"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, text_crc32."""
    rows = sized(docs, doc_id, text, source, seed)
    goals = settle(targets(rows, weights, most), "targets")
    plan = settle(goals.join(seats(goals).select("source_no", "won"), "source_no").withColumnRenamed("source", "name"), "quotas")
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["name"])).drop("name")
    placed = starts(joined, "source_no", "order", F.col("size"), ["text_crc32", "size"], "start")
    rest = F.expr("won % greatest(source_size, 1L)")
    again = F.expr("won div greatest(source_size, 1L)") * F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size"), rest) - F.col("start"))
    return placed.select(
        "doc_id", "size", "source_size", "target", (again + part).cast("long").alias("taken"), "source", "text_crc32"
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it. A
    document at the edge of a stretch is taken whole when at least half of it is inside; documents
    without words are left out. Rows equal in doc_id, source and text share their copies."""
    shares = mix(docs, doc_id, text, source, **how).where("taken > 0")
    copies = (
        shares.withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).where("copies > 0")
        .groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("text_crc32").alias("mix_crc"))
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    )
    own_crc, copy = fresh(docs, "own_crc"), fresh(docs, "copy")
    own = docs.withColumn(own_crc, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    met = own.join(
        copies,
        own[doc_id].eqNullSafe(copies["mix_id"]) & own[source].eqNullSafe(copies["mix_source"]) & (own[own_crc] == copies["mix_crc"]),
    )
    each = F.ceil(copies["copies"] / copies["rows"]).cast("int")
    return met.select(*[own[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), each)).alias(copy)).drop(copy)
