"""License scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation, equal spellings) and its
digest is joined with the digests of known licences. Both the entire text of a document and each
of its lines are looked up that way; nothing else counts as a match.

Defined cases: a null text is empty; a text whose canonical form is empty matches nothing; equal
digests of several licences give the first id in order; rows equal in doc_id and text are answered
alike; an empty table on either side gives no matches; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poledger.llm.license_texts import SPELLINGS, TEXTS, full_texts
from poledger.plans.staging import settle

#: A line that only says who holds the rights.
RIGHTS = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)|©|all rights reserved)[^\n]*"
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, without lines of rights, punctuation and differences in spelling."""
    out = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit("\n"))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, RIGHTS, "\n"), MARKS, " "))
    for written, compared in SPELLINGS:
        out = F.replace(out, F.lit(written), F.lit(compared))
    return out


def known(spark: SparkSession, texts: Sequence[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of (id, text) pairs, or of a table of license_id and text; without
    them, of the texts that come with this package."""
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(full_texts() if texts is None else list(texts), "license_id string, text string")
    form = texts.select("license_id", canonical(F.col("text")).alias("form"))
    return form.where("form <> ''").groupBy(F.sha2(F.col("form").cast("binary"), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license_id (of the entire text, or null),
    n_license_lines, line_licenses (distinct ids, sorted)."""
    table = settle(licenses.select("digest", "license_id"), "licenses")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("sum"), F.col(text).alias("text"))
    line = own.select("doc_id", "sum", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    hits = (
        line.select("doc_id", "sum", F.sha2(canonical(F.col("line")).cast("binary"), 256).alias("digest")).join(table, "digest")
        .groupBy("doc_id", "sum").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("license_id")).alias("ids"))
    )
    # rows equal in doc_id and text count their lines once each
    rows = own.select("doc_id", "sum", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"))
    whole = settle(rows.join(table, "digest", "left").select("doc_id", "sum", F.col("digest").alias("canonical_sha256"), "license_id"), "whole-texts")
    times = whole.groupBy("doc_id", "sum").agg(F.count("*").alias("rows"))
    per = hits.join(times, (hits["sum"] == times["sum"]) & hits["doc_id"].eqNullSafe(times["doc_id"])).select(
        hits["doc_id"].alias("in_doc"), hits["sum"].alias("in_sum"), F.expr("n div rows").alias("n"), "ids"
    )
    return whole.join(per, whole["doc_id"].eqNullSafe(per["in_doc"]) & (whole["sum"] == per["in_sum"]), "left").select(
        "doc_id", "canonical_sha256", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("line_licenses"),
    )
