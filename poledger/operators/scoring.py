"""Runs against truth: outcomes, row matching, tallies, ranking, acceptance.

Truth and prediction meet once per document (headers) or row (lines) while still wide; only
then are they unpivoted, so the shuffle carries one row per document instead of one per field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poledger.functions.fuzzy import token_set_ratio
from poledger.functions.normal import as_number, normalise
from poledger.functions.once import once
from poledger.operators import quantiles
from poledger.operators.pairing import match_by_content
from poledger.plans.staging import settle
from poledger.refdata import (
    COMPUTED_HEADER_FIELDS,
    COMPUTED_LINE_COLUMNS,
    CRITICAL_HEADER_FIELDS,
    CRITICAL_LINE_COLUMNS,
    FIELD_TYPE,
    HEADER_FIELDS,
    LINE_COLUMNS,
    OUTCOMES,
    TARGETS,
)

FUZZY_MIN = 90  # free text counts as fuzzy-correct from here
CORRECT = ("correct", "correct_absent")
ERRORS = ("wrong", "missed", "hallucinated")


def scored(include_computed: bool = True) -> tuple[list[str], list[str]]:
    head = [f for f in HEADER_FIELDS if include_computed or f not in COMPUTED_HEADER_FIELDS]
    line = [c for c in LINE_COLUMNS if include_computed or c not in COMPUTED_LINE_COLUMNS]
    return head, line


def _pairs(names: list[str]) -> Column:
    return F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("field"), F.lit(FIELD_TYPE[n]).alias("ftype"),
            F.col(f"t_{n}").cast("string").alias("truth"), F.col(f"p_{n}").cast("string").alias("pred"),
        )
        for n in names
    ]))


def _side(df: DataFrame, names: list[str], prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def _compared(t: Column, p: Column) -> Column:
    """Outcome of two comparable forms."""
    return (
        F.when(t.isNull() & p.isNull(), "correct_absent").when(p.isNull(), "missed")
        .when(t.isNull(), "hallucinated").when(t == p, "correct").otherwise("wrong")
    )


def with_outcome(pairs: DataFrame) -> DataFrame:
    """(.., ftype, truth, pred) -> adds t, p (comparable forms) and outcome.

    Equal raw texts with a letter or digit are equal in any comparable form, so only the rest
    is normalised; t and p themselves cost nothing unless a later step reads them.
    """
    t, p = normalise(F.col("ftype"), F.col("truth")), normalise(F.col("ftype"), F.col("pred"))
    alike = (F.col("truth") == F.col("pred")) & F.col("truth").rlike(r"[\p{L}\p{N}]")
    outcome = F.when(F.col("truth").isNull() & F.col("pred").isNull(), "correct_absent").when(alike, "correct").otherwise(_compared(t, p))
    return pairs.withColumns({"t": t, "p": p, "outcome": outcome})


def unlike(wide: DataFrame, names: list[str], keys: list) -> DataFrame:
    """(keys, field, ftype, truth, pred, outcome, none): the pairs of wide rows that have to be compared, and
    for each wide row one without field whose `none` has a bit for each field of `names` with no value on either side. All
    other pairs are equal as they stand, which `counts` adds.

    Few pairs leave the wide row, and each of their values is brought to its comparable form once.
    """
    kinds, pairs, gone = dict(wide.dtypes), [], []
    for n in names:
        t, p = F.col(f"t_{n}"), F.col(f"p_{n}")
        kind, truth, pred = kinds[f"t_{n}"], t.cast("string"), p.cast("string")
        # equal numbers and dates of one type print alike, with a digit
        plain = kind == kinds[f"p_{n}"] and (kind in ("int", "bigint", "date") or kind.startswith("decimal"))
        alike = t == p if plain else (truth == pred) & truth.rlike(r"[\p{L}\p{N}]")
        none = t.isNull() & p.isNull()
        gone.append(none)
        pair = [F.lit(n).alias("field"), F.lit(FIELD_TYPE[n]).alias("ftype"), truth.alias("truth"), pred.alias("pred")]
        pairs.append(F.when(~none & ~F.coalesce(alike, F.lit(False)), F.struct(*pair, F.lit(None).cast("bigint").alias("none"))))
    text = F.lit(None).cast("string")
    bits = reduce(lambda all_, i: all_ + F.when(gone[i], 1 << i).otherwise(0), range(len(gone)), F.lit(0).cast("bigint"))
    whole = F.struct(*[text.alias(c) for c in ("field", "ftype", "truth", "pred")], bits.alias("none"))
    rows = wide.select(*keys, F.inline(F.filter(F.array(whole, *pairs), lambda x: x.isNotNull())))
    # each branch of a transform is evaluated as it stands, so the two forms are not copied into every test
    both = once(rows, forms=F.when(F.col("field").isNotNull(), F.transform(F.array("truth", "pred"), lambda v: normalise(F.col("ftype"), v))))
    t, p = F.get("forms", F.lit(0)), F.get("forms", F.lit(1))
    outcome = F.when(F.col("field").isNotNull(), _compared(t, p))
    return both.select(*rows.columns[:-1], outcome.alias("outcome"), "none")


def counts(names: list[str], critical: tuple[str, ...]) -> dict[str, Column]:
    """Sums over rows of `unlike` for the fields `names`: pairs of each outcome, text pairs, exact ones, bad critical ones."""
    outcome, text = F.col("outcome"), F.col("ftype") == "text"
    good, rows = outcome.isin(*CORRECT), F.count_if(F.col("field").isNull())
    texts = rows * sum(FIELD_TYPE[n] == "text" for n in names)
    absent = F.coalesce(F.sum(F.bit_count("none")), F.lit(0))
    out = {o: F.count_if(outcome == o) for o in OUTCOMES}
    out["correct"] = rows * len(names) - absent - F.count("field") + out["correct"]
    out["correct_absent"] = absent + out["correct_absent"]
    return out | {
        "text": texts, "text_exact": texts - F.count_if(text & ~good),
        "critical_bad": F.count_if(F.col("field").isin(*critical) & ~good),
    }


def with_fuzzy(results: DataFrame) -> DataFrame:
    """Adds fuzzy for free text with both values. Only differing texts reach the UDF."""
    both = (F.col("ftype") == "text") & F.col("t").isNotNull() & F.col("p").isNotNull()
    same = F.col("t") == F.col("p")
    differ = both & ~same
    score = token_set_ratio(F.when(differ, F.col("t")), F.when(differ, F.col("p")))
    return results.withColumn("fuzzy", F.when(both & same, F.lit(100.0)).when(both, score))


def score_header(truth: DataFrame, pred: DataFrame, include_computed: bool = True) -> DataFrame:
    """(doc_id, field, ftype, truth, pred, t, p, outcome); no prediction scores as all missed."""
    names, _ = scored(include_computed)
    return with_outcome(_wide_header(truth, pred, names).select("doc_id", _pairs(names)))


def _wide_header(truth: DataFrame, pred: DataFrame, names: list[str]) -> DataFrame:
    return _side(truth, names, "t", ["doc_id"]).join(_side(pred, names, "p", ["doc_id"]), "doc_id", "left")


def unlike_header(truth: DataFrame, pred: DataFrame, include_computed: bool = True) -> DataFrame:
    """Header pairs to compare, as `unlike` gives them, by doc_id."""
    names, _ = scored(include_computed)
    return unlike(_wide_header(truth, pred, names), names, ["doc_id"])


# --- row matching ----------------------------------------------------------------------------
def _usable_number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if dict(df.dtypes)[name] in ("int", "bigint"):
        return c.cast("bigint")
    n = as_number(c.cast("string")).try_cast("decimal(20,2)")
    return F.when(n == F.floor(n), F.floor(n).cast("bigint"))


def match_by_number(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, t_idx, p_idx): predicted numbers that are whole, unique among the predictions and
    in the truth; a number the truth repeats means its last row."""
    t = truth.select("doc_id", "idx", _usable_number(truth, "line_no").alias("n")).filter("n is not null")
    t = t.groupBy("doc_id", "n").agg(F.max("idx").alias("t_idx"))
    p = pred.select("doc_id", "idx", _usable_number(pred, "line_no").alias("n")).filter("n is not null")
    p = p.groupBy("doc_id", "n").agg(F.min("idx").alias("p_idx"), F.count("*").alias("k")).filter("k = 1")
    return t.join(p, ["doc_id", "n"]).select("doc_id", "t_idx", "p_idx")


def match_rows(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, t_idx, p_idx, by_line_no)."""
    numbered = settle(match_by_number(truth, pred), "numbered")
    rest = match_by_content(truth, pred, numbered)
    return numbered.withColumn("by_line_no", F.lit(True)).unionByName(rest.withColumn("by_line_no", F.lit(False)))


def score_cells(truth: DataFrame, pred: DataFrame, matches: DataFrame, include_computed: bool = True) -> DataFrame:
    """(doc_id, row, field, .., outcome) of the matched rows' cells."""
    _, names = scored(include_computed)
    return with_outcome(_wide_cells(truth, pred, matches, names).select("doc_id", F.col("t_line_no").alias("row"), _pairs(names)))


def unlike_cells(truth: DataFrame, pred: DataFrame, matches: DataFrame, include_computed: bool = True) -> DataFrame:
    """Cells of matched rows to compare, as `unlike` gives them, by doc_id and row."""
    _, names = scored(include_computed)
    return unlike(_wide_cells(truth, pred, matches, names), names, ["doc_id", F.col("t_line_no").alias("row")])


def _wide_cells(truth: DataFrame, pred: DataFrame, matches: DataFrame, names: list[str]) -> DataFrame:
    t = _side(truth.withColumnRenamed("idx", "t_idx"), names, "t", ["doc_id", "t_idx"])
    p = _side(pred.withColumnRenamed("idx", "p_idx"), names, "p", ["doc_id", "p_idx"])
    return matches.select("doc_id", "t_idx", "p_idx").join(t, ["doc_id", "t_idx"]).join(p, ["doc_id", "p_idx"])


def unmatched(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Missed truth rows and extra predicted rows: (doc_id, kind, row, description)."""
    miss = truth.join(matches.select("doc_id", F.col("t_idx").alias("idx")), ["doc_id", "idx"], "left_anti")
    extra = pred.join(matches.select("doc_id", F.col("p_idx").alias("idx")), ["doc_id", "idx"], "left_anti")
    cols = ["doc_id", F.col("line_no").alias("row"), "description"]
    return miss.select(F.lit("missed").alias("kind"), *cols).unionByName(
        extra.select(F.lit("hallucinated").alias("kind"), *cols)
    )


# --- per document ----------------------------------------------------------------------------
def doc_scores(truth: DataFrame, header: DataFrame, cells: DataFrame, rows: DataFrame, truth_rows: DataFrame,
               pred_rows: DataFrame, matches: DataFrame, include_computed: bool = True) -> DataFrame:
    """One row of counts per document; every later summary adds these up. `header` and `cells`: what unlike_header
    and unlike_cells give.

    Each input folds to a document row before it shuffles.
    """
    head, line = scored(include_computed)

    def summed(df: DataFrame, tag: str, names: list[str], critical: tuple[str, ...]) -> DataFrame:
        return df.groupBy("doc_id").agg(*[c.alias(f"{tag}_{n}") for n, c in counts(names, critical).items()])

    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    missed = n(rows.filter("kind = 'missed'"), "missed_rows")
    out = truth.select("doc_id")
    for part in (
        summed(header, "h", head, CRITICAL_HEADER_FIELDS), summed(cells, "c", line, CRITICAL_LINE_COLUMNS), missed,
        n(truth_rows, "truth_rows"), n(pred_rows, "pred_rows"), n(matches, "matched_rows"),
    ):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0)
    return out.withColumn(
        "critical_correct",
        (F.col("h_critical_bad") == 0) & (F.col("c_critical_bad") == 0) & (F.col("missed_rows") == 0),
    )


def errors(header: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, field, outcome, row, truth, pred): header fields, cells, missed and extra rows."""
    bad = F.col("outcome").isin(*ERRORS)
    cols = ["doc_id", "field", "outcome", "row", "truth", "pred"]
    head = header.filter(bad).withColumn("row", F.lit(None).cast("int"))
    cell = cells.filter(bad).withColumn("field", F.concat(F.lit("line_items."), "field"))
    missed = F.col("kind") == "missed"
    row = rows.select(
        "doc_id", F.lit("line_items").alias("field"), F.col("kind").alias("outcome"), "row",
        F.when(missed, F.col("description")).alias("truth"), F.when(~missed, F.col("description")).alias("pred"),
    )
    return head.select(cols).unionByName(cell.select(cols)).unionByName(row.select(cols))


# --- summaries -------------------------------------------------------------------------------
def _sum(*names: str) -> Column:
    total = F.lit(0)
    for n in names:
        total = total + F.sum(n)
    return total


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _tally(tag: str) -> dict[str, Column]:
    return {"correct": _sum(f"{tag}_correct", f"{tag}_correct_absent"),
            "total": _sum(*[f"{tag}_{o}" for o in OUTCOMES])}


def group_summary(docs: DataFrame, statuses: tuple[str, ...] = ("completed", "needs_review", "parse_error", "failed"),
                  rows: tuple[str, ...] = ()) -> DataFrame:
    """docs: per-document counts with status, variant, layout, issuer_type -> one row per group
    of the overall set, each variant, each layout and each issuer type. `rows`: counts to add up as they are."""
    g = docs.groupingSets(
        [[], ["variant"], ["layout"], ["issuer_type"]], "variant", "layout", "issuer_type"
    )
    h, c = _tally("h"), _tally("c")
    recall, precision = _ratio(F.sum("matched_rows"), F.sum("truth_rows")), _ratio(F.sum("matched_rows"), F.sum("pred_rows"))
    out = g.agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("docs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
        _ratio(F.count_if("critical_correct"), F.count("*")).alias("critical_doc_accuracy"),
        _ratio(h["correct"] + c["correct"], h["total"] + c["total"]).alias("field_accuracy"),
        _ratio(h["correct"], h["total"]).alias("header_accuracy"),
        _ratio(c["correct"], c["total"]).alias("cell_accuracy"),
        recall.alias("row_recall"), precision.alias("row_precision"),
        F.try_divide(2 * recall * precision, recall + precision).alias("row_f1"),
        *[F.sum(c).alias(c) for c in rows],
    )
    kind = F.when(F.col("variant").isNotNull(), "variant").when(F.col("layout").isNotNull(), "layout").when(
        F.col("issuer_type").isNotNull(), "issuer_type"
    ).otherwise("overall")
    value = F.coalesce("variant", "layout", "issuer_type", F.lit("all"))
    return out.select(kind.alias("group_kind"), value.alias("group_value"), *out.columns[4:])


def field_tally(results: DataFrame) -> DataFrame:
    """Counts per field and outcome, with exact and (where scored) fuzzy text accuracy."""
    good = F.col("outcome").isin(*CORRECT)
    fuzzy_ok = good | F.coalesce(F.col("fuzzy") >= FUZZY_MIN, F.lit(False)) if "fuzzy" in results.columns else None
    text = F.col("ftype") == "text"
    out = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    out += [
        F.count("*").alias("total"), _ratio(F.count_if(good), F.count("*")).alias("accuracy"),
        _ratio(F.count_if(text & good), F.count_if(text)).alias("text_exact_accuracy"),
    ]
    if fuzzy_ok is not None:
        out.append(_ratio(F.count_if(text & fuzzy_ok), F.count_if(text)).alias("text_fuzzy_accuracy"))
    return results.groupBy("field").agg(*out)


def tally(header: DataFrame, cells: DataFrame, include_computed: bool = True) -> DataFrame:
    """Counts as of field_tally over all header fields and all cells: two rows, from what unlike_header and
    unlike_cells give."""
    def summed(df: DataFrame, name: str, names: list[str]) -> DataFrame:
        c = df.agg(*[v.alias(k) for k, v in counts(names, ()).items()]).withColumn("total", sum((F.col(o) for o in OUTCOMES), F.lit(0)))
        return c.filter("total > 0").select(
            F.lit(name).alias("field"), *OUTCOMES, "total", _ratio(F.col("correct") + F.col("correct_absent"), F.col("total")).alias("accuracy"),
            _ratio(F.col("text_exact"), F.col("text")).alias("text_exact_accuracy"),
        )

    head, line = scored(include_computed)
    return summed(header, "header", head).unionByName(summed(cells, "cells", line))


def latency_summary(records: DataFrame) -> DataFrame:
    """Overall and per variant."""
    each = records.withColumn("variant", F.explode(F.array(F.lit("all"), F.col("variant"))))
    out = each.groupBy("variant").agg(
        F.count("*").alias("docs"), F.max("total_ms").cast("double").alias("max_ms"),
        F.avg("prompt_tokens").alias("mean_prompt"), F.avg("completion_tokens").alias("mean_completion"),
        F.avg("reasoning_tokens").alias("mean_reasoning"),
        F.bool_or("reasoning_estimated").alias("estimated"), F.avg("calls").alias("mean_calls"),
        F.count_if(F.col("status") == "parse_error").alias("parse_errors"),
    )
    times = quantiles.exact(each, F.col("total_ms"), {"p50_ms": 0.5, "p95_ms": 0.95}, ["variant"])
    times = times.select(F.col("variant").alias("of"), *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms")])
    return out.join(times, out["variant"].eqNullSafe(times["of"]), "left").drop("of")


def run_summary(records: DataFrame) -> DataFrame:
    """Counts by status, retried documents, p50/p95 in ms, mean completion tokens, reasoning sum."""
    out = records.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "needs_review", "failed")],
        F.count("retried_call").alias("retried"),
        F.avg("completion_tokens").alias("mean_completion"), F.sum("reasoning_tokens").alias("reasoning"),
    )
    return quantiles.beside(out, quantiles.exact(records, F.col("total_ms"), {"p50_ms": 0.5, "p95_ms": 0.95}))


# --- ranking ---------------------------------------------------------------------------------
def with_field_count(errs: DataFrame) -> DataFrame:
    """Each error with its field's error count: a small aggregate joined back (at most 74 fields),
    so no window gathers a frequent field's errors."""
    counts = errs.groupBy("field").agg(F.count("*").alias("n"))
    return errs.join(F.broadcast(counts), "field")


def by_frequency(errs: DataFrame) -> DataFrame:
    """Total order of the error file: a distributed sort."""
    return with_field_count(errs).orderBy(
        F.desc("n"), "field", "doc_id", F.coalesce("row", F.lit(0)), "outcome"
    )


def top_fields(errs: DataFrame, n: int = 10) -> DataFrame:
    """The n fields with most errors and their outcome counts (one row per field: tiny)."""
    counts = errs.groupBy("field").agg(
        F.count("*").alias("errors"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ERRORS]
    )
    return counts.orderBy(F.desc("errors"), "field").limit(n)


def field_examples(errs: DataFrame, top: DataFrame, k: int = 2) -> DataFrame:
    """Up to k examples per top field, from different documents first.

    First each document's first error, ranked within its field (the ranked filter cuts every
    task to k rows before the shuffle); then, where documents run short, the next errors.
    """
    e = errs.join(F.broadcast(top.select("field")), "field")
    order = [F.coalesce("row", F.lit(0)), "outcome"]
    first_in_doc = Window.partitionBy("field", "doc_id").orderBy(*order)
    ranked = e.withColumn("in_doc", F.row_number().over(first_in_doc)).filter(F.col("in_doc") <= k)
    w = Window.partitionBy("field").orderBy((F.col("in_doc") > 1), "doc_id", *order)
    return (
        ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .select("field", "rank", "doc_id", "row", "outcome", "truth", "pred")
    )


# --- decisions -------------------------------------------------------------------------------
def targets_met(summary: DataFrame) -> DataFrame:
    overall = summary.filter("group_kind = 'overall'")
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(goal).alias("target"),
                 F.coalesce(F.col(m) >= goal, F.lit(False)).alias("met"))
        for m, goal in TARGETS.items()
    ]
    return overall.select(F.inline(F.array(*rows)))


def acceptance(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Critical-document accuracy may drop 0.5 points, field accuracy 1 point."""
    pick = lambda df, tag: df.filter("group_kind = 'overall'").select(
        F.coalesce("critical_doc_accuracy", F.lit(0.0)).alias(f"{tag}_c"),
        F.coalesce("field_accuracy", F.lit(0.0)).alias(f"{tag}_f"), F.lit(1).alias("one"),
    )
    j = pick(ref, "r").join(pick(cand, "k"), "one")
    c, f = (F.col("r_c") - F.col("k_c")) * 100, (F.col("r_f") - F.col("k_f")) * 100
    c_ok, f_ok = c <= 0.5 + 1e-9, f <= 1.0 + 1e-9

    judged = lambda name, drop, limit, ok: F.struct(F.lit(name).alias("metric"), F.round(drop, 6).alias("drop_pp"), F.lit(limit).alias("limit_pp"), ok.alias("ok"))
    return j.select(
        F.when(c_ok & f_ok, "ACCEPT").otherwise("REJECT").alias("verdict"),
        F.round(c, 6).alias("critical_drop_pp"), F.round(f, 6).alias("field_drop_pp"),
        F.array(judged("critical_doc_accuracy", c, 0.5, c_ok), judged("field_accuracy", f, 1.0, f_ok)).alias("limits"),
    )


METRICS = {
    "Critical-doc accuracy": "critical_doc_accuracy", "Field accuracy": "field_accuracy",
    "Header accuracy": "header_accuracy", "Cell accuracy": "cell_accuracy",
    "Row recall": "row_recall", "Row precision": "row_precision",
}
LATENCY = {"Latency p50": "p50_ms", "Latency p95": "p95_ms", "Mean completion tokens": "mean_completion",
           "Parse errors": "parse_errors"}


def _metric_rows(summary: DataFrame, latency: DataFrame, tag: str) -> DataFrame:
    def rows(df: DataFrame, names: dict[str, str], prefix: Column) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.concat(prefix, F.lit(n)).alias("metric"), F.col(c).cast("double").alias(tag))
            for n, c in names.items()
        ])))

    no = F.lit("")
    variant = {"critical-doc accuracy": "critical_doc_accuracy", "field accuracy": "field_accuracy"}
    return (
        rows(summary.filter("group_kind = 'overall'"), METRICS, no)
        .unionByName(rows(latency.filter("variant = 'all'"), LATENCY, no))
        .unionByName(rows(summary.filter("group_kind = 'variant'"), variant, F.concat("group_value", F.lit(": "))))
    )


def metric_deltas(ref: tuple[DataFrame, DataFrame], cand: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Side by side: ten overall rows and two per variant; no delta when a side is missing."""
    j = _metric_rows(*ref, "ref").join(_metric_rows(*cand, "cand"), "metric", "full")
    return j.select("metric", F.round("ref", 6).alias("ref"), F.round("cand", 6).alias("cand"),
                    F.round(F.col("cand") - F.col("ref"), 6).alias("delta"))
