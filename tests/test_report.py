"""The report holds all its parts, and they agree with the queries that give each part alone."""

import json

from poledger.catalog import load

SF = "/root/testdata/sf0.001"


def test_report_has_every_part(spark):
    q = load()
    parts = {}
    for r in q["report_json"].run(spark, SF).collect():
        parts.setdefault(r.group_kind, {})[r.group_value] = json.loads(r.numbers)
    assert set(parts) == {"overall", "variant", "layout", "issuer_type", "latency", "target", "problem_field", "errors"}
    latency = {r.variant: r.asDict() for r in q["latency_summary"].run(spark, SF).collect()}
    assert {v: (n["docs"], n["p95_ms"]) for v, n in parts["latency"].items()} == {v: (r["docs"], r["p95_ms"]) for v, r in latency.items()}
    top = {r.field: r.errors for r in q["top_problem_fields"].run(spark, SF).collect()}
    assert {f: n["errors"] for f, n in parts["problem_field"].items()} == top and all(1 <= len(n["examples"]) <= 2 for n in parts["problem_field"].values())
    assert parts["errors"]["all"]["errors"] == q["error_list"].run(spark, SF).count()
    met = {r.metric: (r.value, r.met) for r in q["targets_met"].run(spark, SF).collect()}
    assert {m: (n["value"], n["met"]) for m, n in parts["target"].items()} == met
    whole = parts["overall"]["all"]
    assert len(whole["by_field"]) == 73 and whole["matched_rows"] <= whole["truth_rows"]
    for kind in ("variant", "layout", "issuer_type"):  # each kind of group splits the whole
        for field, tally in whole["by_field"].items():
            for name in ("correct", "correct_absent", "wrong", "missed", "hallucinated", "total"):
                assert sum(g["by_field"][field][name] for g in parts[kind].values()) == tally[name]


def test_field_tallies_agree_with_all_pairs(spark):
    from pyspark.sql import functions as F

    from poledger.catalog.registry import Tables
    from poledger.catalog.scoring import run
    from poledger.operators import report, scoring

    t = Tables(spark, SF)
    s = run(t)
    one = t("po_header").select("doc_id", F.lit("overall").alias("group_kind"), F.lit("all").alias("group_value"), F.lit(1).cast("bigint").alias("n"))
    cols = ["field", "correct", "correct_absent", "wrong", "missed", "hallucinated", "total"]
    got = report.field_tallies(s.unlike_header, scoring.scored()[0], "", one).select(*cols, "text_fuzzy", "text").collect()
    want = {r.field: r for r in scoring.field_tally(scoring.with_fuzzy(s.header)).collect()}
    assert len(got) == len(want) == 58
    for r in got:
        assert tuple(r[c] for c in cols) == tuple(want[r.field][c] for c in cols)
        share = want[r.field].text_fuzzy_accuracy
        assert (r.text == 0 and share is None) or abs(r.text_fuzzy / r.text - share) < 1e-9
