"""A run scored against the truth, and two runs compared."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.operators import scoring
from poledger.plans.staging import settle


@dataclass
class RunScore:
    truth: DataFrame
    truth_rows: DataFrame
    pred: DataFrame
    pred_rows: DataFrame
    matches: DataFrame
    include_computed: bool = True

    @property
    def header(self) -> DataFrame:
        """Every header pair, a row each."""
        return scoring.score_header(self.truth, self.pred, self.include_computed)

    @property
    def cells(self) -> DataFrame:
        """Every cell of the matched rows, a row each."""
        return scoring.score_cells(self.truth_rows, self.pred_rows, self.matches, self.include_computed)

    @cached_property
    def unlike_header(self) -> DataFrame:
        """The header pairs that had to be compared, written once: counts and errors read them."""
        return settle(scoring.unlike_header(self.truth, self.pred, self.include_computed), "unlike-header")

    @cached_property
    def unlike_cells(self) -> DataFrame:
        """The cells that had to be compared, written once."""
        return settle(scoring.unlike_cells(self.truth_rows, self.pred_rows, self.matches, self.include_computed), "unlike-cells")

    @property
    def rows(self) -> DataFrame:
        return scoring.unmatched(self.truth_rows, self.pred_rows, self.matches)

    @cached_property
    def docs(self) -> DataFrame:
        """Counts of each truth document."""
        return scoring.doc_scores(
            self.truth, self.unlike_header, self.unlike_cells, self.rows, self.truth_rows, self.pred_rows, self.matches, self.include_computed
        )

    def error_list(self) -> DataFrame:
        return scoring.errors(self.unlike_header, self.unlike_cells, self.rows)

    def tally(self) -> DataFrame:
        return scoring.tally(self.unlike_header, self.unlike_cells, self.include_computed)

    @cached_property
    def errors(self) -> DataFrame:
        """The error list, written once: ranking reads it several times."""
        return settle(self.error_list(), "errors")


def row_matches(truth_rows: DataFrame, pred_rows: DataFrame) -> DataFrame:
    """Matched rows of a run, written once: cells, unmatched rows and counts all read them."""
    return settle(scoring.match_rows(truth_rows, pred_rows), "matches")


def score(truth: DataFrame, truth_rows: DataFrame, pred: DataFrame, pred_rows: DataFrame,
          include_computed: bool = True, matches: DataFrame | None = None) -> RunScore:
    """All results of one run. `matches`: what row_matches gave for these rows, where it is at hand."""
    return RunScore(truth, truth_rows, pred, pred_rows, row_matches(truth_rows, pred_rows) if matches is None else matches, include_computed)


def unknown_records(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records the manifest does not list: must be empty before scoring."""
    return records.join(manifest.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def with_groups(docs: DataFrame, records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per-document counts for every scored variant, with its grouping columns. A record that the
    manifest does not list raises ValueError."""
    odd = unknown_records(records, manifest).select("doc_id").limit(1).collect()
    if odd:
        raise ValueError(f"record {odd[0]['doc_id']} is not in the manifest")
    return groups(records, manifest).join(docs.withColumnRenamed("doc_id", "po_id"), "po_id")


def groups(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(run_doc, variant, status, po_id, layout, issuer_type) of the run documents in the manifest."""
    m = manifest.select(
        F.col("id").alias("run_doc"), F.col("doc_id").alias("po_id"), "layout",
        F.when(F.col("issuer_frequent") == "True", "frequent").otherwise("one_off").alias("issuer_type"),
    )
    r = records.select(F.col("doc_id").alias("run_doc"), "variant", "status")
    return r.join(m, "run_doc")


def oracle_run(manifest: DataFrame) -> DataFrame:
    """Records of a run whose outputs are the truth: completed, no time, no tokens."""
    zero = F.lit(0).cast("bigint")
    return manifest.select(
        F.col("id").alias("doc_id"), "variant", F.col("doc_id").alias("po_id"),
        F.lit("completed").alias("status"), F.lit(0).cast("decimal(15,2)").alias("total_ms"),
        F.lit(0).alias("calls"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"),
        F.lit(None).cast("bigint").alias("reasoning_tokens"), F.lit(False).alias("reasoning_estimated"),
        F.lit(None).cast("string").alias("retried_call"),
    )


def common_records(ref: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ref and cand records of the shared documents, counts of the others)."""
    r = ref.select("doc_id", F.lit(True).alias("in_ref"))
    c = cand.select("doc_id", F.lit(True).alias("in_cand"))
    counts = r.join(c, "doc_id", "full").agg(
        F.count_if(F.col("in_ref") & F.col("in_cand")).alias("common"),
        F.count_if(F.col("in_cand").isNull()).alias("ref_only"),
        F.count_if(F.col("in_ref").isNull()).alias("cand_only"),
    )
    return ref.join(c, "doc_id", "left_semi"), cand.join(r, "doc_id", "left_semi"), counts
