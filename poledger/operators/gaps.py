"""Neighbours and gaps in each document's line numbers, without a document-wide window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # line numbers per block: the most one window partition can hold
CHUNK = 10_000  # missing numbers listed per array


def line_gaps(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no distinct, call_id) -> one row per gap:
    (doc_id, step, first, last, missing, before_call, after_call).

    Numbers are cut into blocks of line numbers. Within a block a window finds each number's
    predecessor; one summary row per block links the blocks. So a document with very many
    lines spreads over its blocks, and only block summaries meet in one place.
    """
    steps = lines.groupBy("doc_id").agg(
        F.when(F.bool_and(F.col("line_no") % 10 == 0), 10).otherwise(1).alias("step")
    )
    cut = lines.withColumn("block", F.floor(F.col("line_no") / BLOCK))
    inner = Window.partitionBy("doc_id", "block").orderBy("line_no")
    here = F.struct("line_no", "call_id")
    within = cut.withColumn("prev", F.lag(here).over(inner))
    edges = cut.groupBy("doc_id", "block").agg(
        F.min(here).alias("low"), F.max(here).alias("high")
    )
    outer = Window.partitionBy("doc_id").orderBy("block")
    linked = edges.withColumn("prev", F.lag("high").over(outer))
    pairs = within.filter("prev is not null").select("doc_id", "prev", here.alias("cur")).unionByName(
        linked.select("doc_id", "prev", F.col("low").alias("cur"))
    )
    step = F.col("step")
    before, after = F.col("prev.line_no"), F.col("cur.line_no")
    # The first expected number above `before`: numbering starts at the step itself.
    first = F.greatest(F.floor(F.coalesce(before, F.lit(0)) / step) + 1, F.lit(1)) * step
    missing = F.floor((after - 1) / step) - first / step + 1
    return (
        pairs.join(steps, "doc_id")
        .select(
            "doc_id", "step", first.cast("bigint").alias("first"),
            missing.cast("bigint").alias("missing"),
            F.col("prev.call_id").alias("before_call"), F.col("cur.call_id").alias("after_call"),
        )
        .filter("missing > 0")
    )


def missing_numbers(gaps: DataFrame) -> DataFrame:
    """(doc_id, line_no) of every missing number, a bounded array at a time."""
    chunked = gaps.select(
        "doc_id", "step", "first", "missing",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("missing") - 1, F.lit(CHUNK).cast("bigint"))).alias("from"),
    )
    upto = F.least(F.col("from") + CHUNK - 1, F.col("missing") - 1)
    return chunked.select(
        "doc_id", "step", "first", F.explode(F.sequence(F.col("from"), upto)).alias("i")
    ).select("doc_id", (F.col("first") + F.col("i") * F.col("step")).cast("int").alias("line_no"))
