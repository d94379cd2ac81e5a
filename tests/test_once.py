"""Costly expressions stand once in a plan, however many columns read them; results stay."""

import json

import pytest

from poledger.operators import ingest, pages, rules
from poledger.refdata import HEADER_FIELDS, header_sql_type


@pytest.fixture
def plan_text(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_header_answer_is_parsed_once(spark, plan_text):
    # a repeated full name: the later key counts
    answer = json.dumps({"po_no": "old", "po_number": "new", "po_dt": "05/01/2026", "foo": 1, "subtotal": "x"})
    header, errors = ingest.merge_header(spark.createDataFrame([(1, "H", answer)], "doc_id long, call_id string, answer string"))
    row = header.first()
    assert (row["po_number"], str(row["po_date"]), row["subtotal"], row["cgst_total"]) == ("new", "2026-01-05", None, 0)
    assert sorted(r["field"] for r in errors.collect()) == ["foo", "subtotal"]
    assert plan_text(header).count("from_json") == 1


def test_words_are_read_once(spark, plan_text):
    schema = ", ".join(["doc_id long", *[f"{f} {header_sql_type(f)}" for f in HEADER_FIELDS]])
    row = {"doc_id": 1, "amount_in_words": "Rupees Ten Only", "grand_total": 11}
    header = spark.createDataFrame([], schema).unionByName(
        spark.createDataFrame([(1, "Rupees Ten Only", "11")], "doc_id long, amount_in_words string, grand_total string")
        .withColumn("grand_total", rules.F.col("grand_total").cast("decimal(18,2)")), allowMissingColumns=True)
    none = spark.createDataFrame([], "doc_id long, line_no int, call_id string, item_code string, quantity decimal(15,3), taxable_value decimal(18,2), gst_rate decimal(5,2), "
                                     "cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2)")  # fmt: skip
    found = rules.problems(rules.Merged(header, none, none, none, none), ("amount_in_words",))
    assert [(r["doc_id"], r["rule"]) for r in found.collect()] == [(row["doc_id"], "amount_in_words")]
    assert plan_text(found).count("aggregate(") == 1
def test_first_pages_are_not_shuffled(spark, plan_text):
    text = "Phone:\n" + "word " * 30
    given = [(1, 1, text + "\nPhone:"), (1, 2, "98765 43210 and so on " * 1), (2, 1, text + "98765 11111"), (3, 0, "x\nmobile"), (3, 1, "98765 22222 is it")]
    found = spark.createDataFrame([(d, p, t, True) for d, p, t in given], "doc_id long, page_no int, layer string, kept boolean")
    got = {(r["doc_id"], r["value"], r["first_page"]) for r in pages.hints(found, ("phone",)).collect()}
    assert (1, "9876543210", 2) in got and (3, "9876522222", 1) in got
    plan = pages._with_carry(found.filter("doc_id < 3"))
    assert "Union" in plan_text(plan) and plan.count() == 3


@pytest.mark.parametrize("n", [49, 50, 51])
def test_kind_by_letters(spark, n):
    got = pages.page_features(spark.createDataFrame([(1, 1, " -" + "é7"[n % 2] * n + "\n.")], "doc_id long, page_no int, text string")).first()
    assert got["kind"] == ("native" if n > 50 else "scanned")


def test_dense_figures_cost_no_look_behind(spark):
    """Only a figure that starts a number of a phone's length is looked back from."""
    assert pages.PHONE.index(pages._NUMBER) < pages.PHONE.index("(?<=(")

def test_text_files_are_compressed(spark):
    from poledger.catalog import load

    back = load()["truth_headers"].run(spark, "/root/testdata/sf0.001")
    assert all(name.endswith(".gz") for name in back.inputFiles())


def test_short_documents_need_no_seeds(spark, monkeypatch):
    needles = spark.createDataFrame([(1, "SHORT"), (2, "FARAWAYWORD"), (2, "GONE")], "doc_id long, needle string")
    b = pages.BREAK
    stream = spark.createDataFrame(
        [(1, 1, f"{b}A{b}SHORT{b}"), (2, 1, b + f"FILL{b}" * 1200), (2, 2, f"{b}FARAWAY{b}WORD{b}")], "doc_id long, page_no int, stream string"
    )
    seeded, real = [], pages._text_seeds
    monkeypatch.setattr(pages, "_text_seeds", lambda blocks: seeded.extend(r[0] for r in blocks.select("doc_id").collect()) or real(blocks))
    assert sorted(map(tuple, pages.search(needles, stream).collect())) == [(1, "SHORT"), (2, "FARAWAYWORD")]
    assert set(seeded) == {2}
