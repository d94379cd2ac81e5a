"""Answers to envelope in two rounds.

Round 1 merges the first answers and checks all eleven rules; its verdicts choose the calls that run
again. Round 2 merges, for those documents only, the better answer of each call and checks them
anew; the last verdict of a document counts. Each round's checks are a written table, so a lost task
repeats one round and not the chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.operators import ingest, pages, routing, rules
from poledger.plans.staging import settle
from poledger.refdata import RULES


@dataclass
class Inputs:
    """What the chain reads."""

    answers: DataFrame  # doc_id, call_id, page_no, attempt (first, retry), content, reasoning, finish_reason, request_error
    calls: DataFrame  # doc_id, seq, call_id, kind, max_tokens: the planned calls
    elapsed: DataFrame  # doc_id, elapsed_s when the first round ended
    features: DataFrame  # page features, for grounding
    parties: DataFrame
    items: DataFrame
    processed: DataFrame


@dataclass
class Round:
    number: int
    merged: rules.Merged
    problems: DataFrame
    checks: DataFrame


@dataclass
class Outcome:
    parsed: DataFrame  # all answers with error_kind
    failed: DataFrame  # doc_id, error: a request of the first round failed
    first: Round
    second: Round
    retried: DataFrame  # doc_id, seq, call_id, alias, max_tokens
    gate: DataFrame  # doc_id, retry, skipped
    checks: DataFrame  # last verdict of each document and rule
    status: DataFrame  # doc_id, status


def merge_answers(answers: DataFrame, calls: DataFrame, docs: DataFrame, given: Inputs) -> rules.Merged:
    """One answer per call to a merged order for each document of `docs`: what cannot be read becomes header
    errors, row errors and missing calls."""
    # written once: the header and its errors read the same answers, and so do the rows and theirs
    typed = docs.select("doc_id").join(ingest.typed_header(answers.filter("ok and call_id = 'H'")), "doc_id", "left")
    header, header_error = ingest.header_parts(settle(typed, "header"))
    listed = F.coalesce(F.ltrim(F.get_json_object("answer", "$.rows")).startswith("["), F.lit(False))
    rows, unreadable = ingest.row_parts(settle(ingest.split_rows(answers.filter("ok and call_id <> 'H'").filter(listed)), "rows"))
    once = settle(ingest.dedupe_rows(ingest.join_fragments(rows)), "rows-once")
    lines, untyped = ingest.type_rows(once)
    place = F.coalesce("page_no", F.lit(0)).cast("bigint") * 1_000_000_000 + F.col("idx")
    row_error = unreadable.select("doc_id", "call_id", F.lit(None).cast("int").alias("line_no"), "message", place.alias("seq")).unionByName(
        untyped.select("doc_id", "call_id", "line_no", "message", (place + F.lit(1 << 60)).alias("seq"))
    )
    lines = settle(lines, "lines")
    verdicts = settle(pages.ground(pages.grounding_values(header, lines), given.features.join(docs.select("doc_id"), "doc_id", "left_semi")), "verdicts")
    return rules.Merged(
        header, lines, settle(header_error, "header-errors"), settle(row_error, "row-errors"), settle(ingest.missing_calls(answers, calls), "missing"),
        given.parties, given.items, given.processed, verdicts,
    )


def _round(number: int, answers: DataFrame, calls: DataFrame, docs: DataFrame, given: Inputs) -> Round:
    merged = merge_answers(answers, calls, docs, given)
    found = settle(rules.problems(merged), f"round{number}-problems")
    return Round(number, merged, found, settle(rules.checks(merged, RULES, found), f"round{number}-checks"))


def failed_requests(parsed: DataFrame) -> DataFrame:
    """(doc_id, error): documents with a request of the first round that failed, with the calls in order."""
    bad = parsed.filter(F.col("attempt") == "first").filter(F.col("error_kind").isin(*routing.CALL_ERRORS))
    said = F.concat_ws(": ", "call_id", "error_kind")
    order = F.coalesce("page_no", F.lit(0))
    return bad.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), said.alias("e")))), lambda s: s["e"]), "; ").alias("error")
    )


def run(given: Inputs, max_reasks: int = 1) -> Outcome:
    """Both rounds. A retry that failed keeps the first answer of its call."""
    parsed = settle(ingest.parse_answers(given.answers), "parsed")
    failed = settle(failed_requests(parsed), "failed-requests")
    docs = settle(given.calls.select("doc_id").distinct().join(failed, "doc_id", "left_anti"), "documents")
    calls = given.calls.join(docs, "doc_id", "left_semi")
    first_answers = parsed.filter("attempt = 'first'").join(docs, "doc_id", "left_semi")
    first = _round(1, first_answers, calls, docs, given)

    wanted = routing.calls_to_retry(first.checks, calls)
    gate = settle(routing.retry_gate(first.checks, given.elapsed, wanted, max_reasks), "gate")
    again = gate.filter("retry").select("doc_id")
    retried = settle(wanted.join(again, "doc_id", "left_semi"), "retried")
    better = parsed.filter("attempt = 'retry'").join(retried.select("doc_id", "call_id"), ["doc_id", "call_id"], "left_semi")
    answers = ingest.best_answer(first_answers.join(again, "doc_id", "left_semi").unionByName(better))
    second = _round(2, answers, calls.join(again, "doc_id", "left_semi"), again, given)

    last = first.checks.join(again, "doc_id", "left_anti").unionByName(second.checks)
    checks = settle(last, "last-checks")
    passed = checks.groupBy("doc_id").agg(F.bool_and("passed").alias("passed"))
    status = passed.select("doc_id", F.when(F.col("passed"), "completed").otherwise("needs_review").alias("status")).unionByName(
        failed.select("doc_id", F.lit("failed").alias("status"))
    )
    return Outcome(parsed, failed, first, second, retried, gate, checks, status)


def _last(out: Outcome, part: str) -> DataFrame:
    """A table of the round that counts for each document."""
    again = out.gate.filter("retry").select("doc_id")
    return getattr(out.first.merged, part).join(again, "doc_id", "left_anti").unionByName(getattr(out.second.merged, part))


def last_header(out: Outcome) -> DataFrame:
    return _last(out, "header")


def last_lines(out: Outcome) -> DataFrame:
    return _last(out, "lines")


def failed_fields(out: Outcome) -> DataFrame:
    """(doc_id, rule, field) of the last verdicts, a row per field."""
    again = out.gate.filter("retry").select("doc_id")
    old = rules.check_fields(out.first.merged, RULES, out.first.problems).join(again, "doc_id", "left_anti")
    return old.unionByName(rules.check_fields(out.second.merged, RULES, out.second.problems))


def review(out: Outcome) -> DataFrame:
    """(doc_id, failed_rules, failed_fields): what a reviewer looks at, for documents that need it."""
    fields = failed_fields(out).join(out.checks.filter("not passed").select("doc_id", "rule"), ["doc_id", "rule"], "left_semi")
    return routing.review_queue(out.checks, fields)


def routed(out: Outcome, plans: DataFrame) -> DataFrame:
    """Plan of each document with what was retried: retried_calls in plan order, retry_alias, retry_skipped."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "call_id"))), lambda s: s["call_id"])
    done = out.retried.groupBy("doc_id").agg(F.array_join(listed, ",").alias("retried_calls"), F.max("alias").alias("retry_alias"))
    gate = out.gate.select("doc_id", F.col("skipped").alias("retry_skipped"))
    return plans.join(done, "doc_id", "left").join(gate, "doc_id", "left").withColumn("retried_calls", F.coalesce("retried_calls", F.lit("")))


def envelopes(out: Outcome, plans: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """One nested row per document: status, error, data, validation, review, routing. Lines, failed
    fields and pages stay tables beside it (last_lines, failed_fields, page features)."""
    verdict = F.array_sort(F.collect_list(F.struct("rule", "passed", "detail", "retry_target", "retryable")))
    validation = out.checks.groupBy("doc_id").agg(F.bool_and("passed").alias("passed"), verdict.alias("checks"))
    header = last_header(out)
    data = header.select("doc_id", F.struct(*[c for c in header.columns if c != "doc_id"]).alias("data"))
    lines = last_lines(out).groupBy("doc_id").agg(F.count("*").alias("line_count"))
    routing_part = routed(out, plans).select("doc_id", F.struct("strategy", "reason", "estimated_rows", "item_pages", "retried_calls", "retry_alias", "retry_skipped").alias("routing"))
    tokens = out.parsed.groupBy("doc_id").agg(F.count_if("ok").alias("answers"), F.count("*").alias("calls"))
    joined = out.status.join(out.failed, "doc_id", "left").join(data, "doc_id", "left").join(validation, "doc_id", "left")
    joined = joined.join(review(out), "doc_id", "left").join(routing_part, "doc_id", "left").join(lines, "doc_id", "left").join(tokens, "doc_id", "left")
    if timeline is not None:
        joined = joined.join(timeline, "doc_id", "left")
    return joined.withColumn("validation", F.when(F.col("passed").isNotNull(), F.struct("passed", "checks"))).withColumn(
        "review", F.when(F.col("status") == "needs_review", F.struct("failed_rules", "failed_fields"))
    ).drop("passed", "checks", "failed_rules", "failed_fields")
