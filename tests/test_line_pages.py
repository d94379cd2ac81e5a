"""Pages of lines against a loop over a document's lines."""

import random

import pytest

from poledger.operators import pages


def loop(per_line):
    out, page, doc = [], 0, None
    for d, n, candidates in sorted(per_line):
        if d != doc:
            doc, page = d, 0
        hit = next((p for p in sorted(candidates) if p >= page), None)
        if hit is not None:
            page = hit
            out.append((d, n, hit))
    return sorted(out)


@pytest.mark.parametrize("lines", [2, 3, 128])
def test_the_scan_equals_a_loop(spark, monkeypatch, lines):
    monkeypatch.setattr(pages, "LINES", lines)
    rng = random.Random(lines)
    rows = []
    for d in ("a", "b", "c", "long"):
        numbers = sorted(rng.sample(range(1, 2000), 300 if d == "long" else 25))
        for k, n in enumerate(numbers):
            at = k * 12 // len(numbers) + 1
            rows.append((d, n, sorted({max(1, at + rng.randrange(-3, 3)) for _ in range(rng.randrange(1, 4))})))
    df = spark.createDataFrame(rows, "doc_id string, line_no int, pages array<int>")
    assert sorted(tuple(r) for r in pages.in_order(df).collect()) == loop(rows)
    assert pages.in_order(df.limit(0)).count() == 0


def test_values_inside_longer_figures_count(spark):
    lines = spark.createDataFrame([("x", 1, "234.50", "1,234.50"), ("x", 2, "7.00", "8.00")], "doc_id string, line_no int, t string, l string")
    typed = lines.selectExpr("doc_id", "line_no", "cast(replace(t, ',', '') as decimal(18,2)) as taxable_value", "cast(replace(l, ',', '') as decimal(18,2)) as line_total")
    text = spark.createDataFrame([("x", 1, "total 91,234.50 and 17.00"), ("x", 2, "5.7.00 8.00"), ("x", 3, "7.00 8.00")], "doc_id string, page_no int, text string")
    assert sorted(tuple(r) for r in pages.lines_per_page(typed, text).collect()) == [("x", 1, 1), ("x", 2, 2)]
