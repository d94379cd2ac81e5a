"""Readers and writers, run over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog.registry import query
from poledger.plans import evaluation
from poledger.plans.staging import place
from poledger.refdata import HEADER_FIELDS, HEADER_KIND
from poledger.sources import runs


#: Text files of queries are compressed: JSON repeats its keys in every line.
PACKED = "gzip"


def _path(t, name: str) -> str:
    return place(t.spark, name)


@query("manifest_scan", "SELECT id, layout, issuer_frequent = 'True' AS frequent, len(string_split(page_kinds, ' ')) AS pages FROM manifest WHERE split = 'dev' AND variant IN ('N', 'S')")
def manifest_scan(t):
    path = _path(t, "manifest")
    m = t("manifest")
    m.select(*[F.col(c) if c in m.columns else F.lit("").alias(c) for c in runs.MANIFEST_COLUMNS]).write.csv(path, header=True, compression=PACKED)
    back = runs.read_manifest(t.spark, path, "dev", ("N", "S"))
    return back.select("id", "layout", F.col("issuer_frequent").alias("frequent"), F.size("page_kinds").cast("bigint").alias("pages"))


def _record_lines(t):
    r = t("records")
    good = F.to_json(F.struct(
        "doc_id", "variant", "status", F.create_map(F.lit("total"), F.col("total_ms").cast("string")).alias("timings_ms"),
        F.struct(F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion")).alias("tokens"), "calls",
    ))
    line = (
        F.when(F.col("po_id") % 101 == 0, F.lit("{broken"))
        .when(F.col("po_id") % 103 == 0, F.regexp_replace(good, r'"total"', '"llm"'))
        .when(F.col("po_id") % 107 == 0, F.regexp_replace(good, r'"variant"', '"colour"'))
        .otherwise(good)
    )
    path = _path(t, "records")
    r.select(line.alias("value")).write.text(path, compression=PACKED)
    return runs.read_records(t.spark, path)


_OK = "po_id % 101 <> 0 AND po_id % 103 <> 0 AND po_id % 107 <> 0"


@query("records_scan", f"SELECT doc_id, status, calls, CAST(total_ms AS DOUBLE) AS total_ms FROM records WHERE {_OK}")
def records_scan(t):
    return _record_lines(t)[0].select("doc_id", "status", "calls", "total_ms")


@query(
    "records_refused",
    """SELECT CASE WHEN po_id % 101 = 0 THEN 'not a record' WHEN po_id % 103 = 0 THEN 'no total time' ELSE 'unknown key' END AS problem, count(*) AS n
       FROM records WHERE po_id % 101 = 0 OR po_id % 103 = 0 OR po_id % 107 = 0 GROUP BY 1""",
)
def records_refused(t):
    return _record_lines(t)[1].groupBy("problem").agg(F.count("*").alias("n"))


def _truth(t):
    path = _path(t, "truth")
    runs.truth_lines(t("po_header"), t("po_line")).write.text(path, compression=PACKED)
    return runs.read_truth(t.spark, path, lines=True)


_NUMBERS = ("quantity", "unit_rate", "discount_pct", "taxable_value", "gst_rate", "cgst_amount", "sgst_amount", "igst_amount", "line_total")


@query("truth_scan", "SELECT doc_id, line_no, item_code, description, hsn_sac, uom, CAST(line_delivery_date AS VARCHAR) AS line_delivery_date, "
       + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NUMBERS) + " FROM po_line")
def truth_scan(t):
    """Line items of truth documents, written as nested JSON and read back."""
    lines = _truth(t)[1]
    return lines.select(
        F.col("id").cast("bigint").alias("doc_id"), "line_no", "item_code", "description", "hsn_sac", "uom", F.col("line_delivery_date").cast("string").alias("line_delivery_date"),
        *[F.col(c).cast("double").alias(c) for c in _NUMBERS],
    )


@query("truth_headers", "SELECT doc_id, " + ", ".join(f"CAST({f} AS {'DOUBLE' if HEADER_KIND[f] == 'money' else 'VARCHAR'}) AS {f}" for f in HEADER_FIELDS) + " FROM po_header")
def truth_headers(t):
    """All header fields of truth documents, written as nested JSON and read back."""
    head = _truth(t)[0]
    return head.select(F.col("id").cast("bigint").alias("doc_id"), *[F.col(f).cast("double" if HEADER_KIND[f] == "money" else "string").alias(f) for f in HEADER_FIELDS])


def _output_lines(header):
    """JSON lines of outputs: one per document that has a prediction."""
    po = F.struct(*HEADER_FIELDS)
    return header.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.lit("completed").alias("status"), po.alias("po"))).alias("value"))


@query("outputs_scan", """SELECT r.doc_id, p.doc_id IS NOT NULL AS has_output, buyer_name, po_number, CAST(grand_total AS DOUBLE) AS grand_total, CAST(po_date AS VARCHAR) AS po_date
       FROM records r LEFT JOIN pred_header p ON p.doc_id = r.po_id""")
def outputs_scan(t):
    """Outputs by document; a document without one has no prediction."""
    path = _path(t, "outputs")
    _output_lines(t("pred_header")).write.text(path, compression=PACKED)
    out = runs.read_outputs(t.spark, path, lines=True).select(
        F.col("doc_id").cast("bigint").alias("po_id"), F.lit(True).alias("has"), "po.buyer_name", "po.po_number",
        F.col("po.grand_total").cast("double").alias("grand_total"), F.col("po.po_date").cast("string").alias("po_date"),
    )
    return t("records").join(out, "po_id", "left").select("doc_id", F.coalesce("has", F.lit(False)).alias("has_output"), "buyer_name", "po_number", "grand_total", "po_date")


@query("raw_calls_scan", "SELECT doc_id, call_id, attempt, finish_reason, length(content) AS chars, md5(content) AS content_md5 FROM call_answer")
def raw_calls_scan(t):
    """Raw answers written as one JSON document per order, read back a row per call."""
    path = _path(t, "raw")
    call = F.struct("call_id", "attempt", F.lit("po-fast").alias("alias"), F.coalesce("request_error", F.lit("ok")).alias("status"), "finish_reason", "content", "reasoning")
    calls = t("call_answer").groupBy("doc_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    calls.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "calls")).alias("value")).write.text(path, compression=PACKED)
    back = runs.read_raw_calls(t.spark, path, lines=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "call_id", "attempt", "finish_reason", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("content_md5"))


@query("run_roundtrip", """
    SELECT r.doc_id, status, CAST(total_ms AS DOUBLE) AS total_ms, 'run' AS pipeline, buyer_name FROM records r LEFT JOIN pred_header p ON p.doc_id = r.po_id""")
def run_roundtrip(t):
    """A run of three tables, published by one commit, written over once, and read back."""
    root = _path(t, "runs")
    tables = {"config": runs.config_row(t.spark, pipeline="run"), "records": t("records").limit(0), "outputs": t("pred_header").limit(0)}
    runs.write_run(tables, root, "r1")
    runs.write_run({**tables, "records": t("records"), "outputs": t("pred_header")}, root, "r1", overwrite=True)
    records, outputs, config = (runs.read_run(t.spark, root, "r1", n) for n in ("records", "outputs", "config"))
    named = records.join(outputs.select(F.col("doc_id").alias("po_id"), "buyer_name"), "po_id", "left").withColumn("one", F.lit(1))
    with_config = named.join(config.select(F.lit(1).alias("one"), "pipeline"), "one")
    return with_config.select("doc_id", "status", F.col("total_ms").cast("double").alias("total_ms"), "pipeline", "buyer_name")


@query("oracle_records", "SELECT id AS doc_id, variant, 'completed' AS status, CAST(0 AS DOUBLE) AS total_ms, po_number FROM manifest m JOIN po_header h ON h.doc_id = m.doc_id")
def oracle_records(t):
    """The oracle run through the run store: its records and the truth as its outputs."""
    root = _path(t, "oracle")
    runs.write_run({"records": evaluation.oracle_run(t("manifest")), "outputs": t("po_header")}, root, "oracle")
    records, outputs = (runs.read_run(t.spark, root, "oracle", n) for n in ("records", "outputs"))
    met = records.join(outputs.select(F.col("doc_id").alias("po_id"), "po_number"), "po_id")
    return met.select("doc_id", "variant", "status", F.col("total_ms").cast("double").alias("total_ms"), "po_number")


def _masters(t):
    root = _path(t, "masters")
    runs.write_masters(t("master_party"), t("master_item"), t("master_processed"), root, compression=PACKED)
    return runs.read_masters(t.spark, root, lines=True)


@query("masters_out", "SELECT gstin, name, state_code, role FROM master_party")
def masters_out(t):
    return _masters(t)[0].select("gstin", "name", "state_code", "role")


@query("masters_read", """SELECT 'item' AS kind, issuer_gstin, item_code AS value FROM master_item
       UNION ALL SELECT 'number', issuer_gstin, po_number FROM master_processed""")
def masters_read(t):
    """Items and processed numbers of master files."""
    _, items, processed = _masters(t)
    return items.select(F.lit("item").alias("kind"), "issuer_gstin", F.col("item_code").alias("value")).unionByName(
        processed.select(F.lit("number").alias("kind"), "issuer_gstin", F.col("po_number").alias("value"))
    )


@query("file_inventory")
def file_inventory(t):
    """SHA-256 ids of the given table files."""
    return runs.file_inventory(t.spark, f"{t.sf_dir}/*.parquet")
