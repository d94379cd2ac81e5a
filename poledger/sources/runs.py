"""Run folders: manifests, truth, records, outputs, raw answers, error and report files.

Readers take declared schemas and never infer; rows that do not fit land in a reject table. Document files may
be one file per document or, for many documents, JSON lines that name their document.

A run is a set of tables that appears at once: they are written under a version of their own, then one row of a
commit table names the version. Readers look the version up there, so a half-written run is not seen, and
overwriting a run is a new version with a later row.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poledger.operators import scoring
from poledger.refdata import HEADER_FIELDS, LINE_COLUMNS, LINE_TYPE, header_sql_type

MANIFEST_COLUMNS = (
    "id", "base_id", "variant", "page_kinds", "issuer_id", "issuer_frequent", "expected_duplicate",
    "layout", "split", "seed", "page_count", "line_count", "fieldless_pages", "has_tc_page",
    "rows_may_break", "inter_state", "po_number", "grand_total", "pdf", "truth",
)
STATUSES = ("completed", "needs_review", "parse_error", "failed")
RECORD_SCHEMA = (
    "doc_id string, variant string, status string, timings_ms map<string,string>, "
    "tokens struct<prompt:bigint,completion:bigint,reasoning:bigint,reasoning_estimated:boolean>, "
    "calls int, error string, routing string, _corrupt string"
)
RECORD_KEYS = ("doc_id", "variant", "status", "timings_ms", "tokens", "calls", "error", "routing")
PO_SCHEMA = (
    "struct<"
    + ",".join(f"{f}:{header_sql_type(f)}" for f in HEADER_FIELDS)
    + ",line_items:array<struct<"
    + ",".join(f"{c}:{LINE_TYPE[c]}" for c in LINE_COLUMNS)
    + ">>>"
)
CONFIG_SCHEMA = (
    "pipeline string, model_alias string, strategy string, dpi int, thinking string, "
    "git_commit string, timestamp string, extra map<string,string>"
)
CALL_SCHEMA = (
    "array<struct<call_id:string,attempt:string,alias:string,status:string,error:string,finish_reason:string,"
    "tokens:struct<prompt:bigint,completion:bigint,reasoning:bigint>,duration_ms:double,attempts:int,"
    "content:string,reasoning:string>>"
)


def _doc_of(path) :
    return F.regexp_extract(path, r"([^/]+)\.json\z", 1)


def read_manifest(spark: SparkSession, path: str, split: str | None = None,
                  variants: tuple[str, ...] = ("N", "S", "M")) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in MANIFEST_COLUMNS)
    return typed_manifest(spark.read.csv(path, header=True, schema=schema, enforceSchema=False), split, variants)


def typed_manifest(raw: DataFrame, split: str | None = None,
                   variants: tuple[str, ...] = ("N", "S", "M")) -> DataFrame:
    """Flags and page kinds typed; the split and variant filters reach the scan."""
    df = raw.filter(F.col("variant").isin(*variants))
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.withColumn("issuer_frequent", F.col("issuer_frequent") == "True").withColumn(
        "page_kinds", F.split(F.trim("page_kinds"), r"\s+")
    )


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(header, lines) of truth documents: one JSON file each, or JSON lines with the id in `meta`."""
    raw = spark.read.schema(f"po {PO_SCHEMA}, meta map<string,string>").json(path, multiLine=not lines)
    name = F.try_element_at("meta", F.lit("id")) if lines else _doc_of(F.input_file_name())
    po = raw.select(name.alias("id"), "po.*")
    return po.drop("line_items"), po.select("id", F.inline("line_items"))


def truth_lines(header: DataFrame, lines: DataFrame) -> DataFrame:
    """JSON lines of truth documents from doc_id with header fields and from line items."""
    items = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*LINE_COLUMNS))).alias("line_items"))
    po = F.struct(*HEADER_FIELDS, "line_items")
    meta = F.create_map(F.lit("id"), F.col("doc_id").cast("string"))
    return header.join(items, "doc_id", "left").select(F.to_json(F.struct(po.alias("po"), meta.alias("meta"))).alias("value"))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects). A record needs doc_id, a known status and a total time; a line with an
    unknown key is refused."""
    return split_records(spark.read.text(path).filter(F.trim("value") != ""))


def split_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    keys = F.json_object_keys("value")
    r = lines.withColumn("r", F.from_json("value", RECORD_SCHEMA, opts)).withColumn(
        "unknown", F.array_except(keys, F.array(*[F.lit(k) for k in RECORD_KEYS]))
    )
    problem = (
        F.when(F.col("r._corrupt").isNotNull() | keys.isNull(), "not a record")
        .when(F.size("unknown") > 0, "unknown key")
        .when(F.col("r.doc_id").isNull(), "no doc_id")
        .when(~F.coalesce(F.col("r.status").isin(*STATUSES), F.lit(False)), "unknown status")
        .when(F.try_element_at("r.timings_ms", F.lit("total")).isNull(), "no total time")
    )
    r = r.withColumn("problem", problem)
    good = r.filter("problem is null").select("r.*").drop("_corrupt")
    total = F.element_at("timings_ms", "total").try_cast("double")
    return good.withColumn("total_ms", total), r.filter("problem is not null").select("value", "problem")


def read_outputs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, status, po, error) of one JSON document per file or line; a missing one has no row."""
    raw = spark.read.text(path, wholetext=not lines)
    return raw.select(F.from_json("value", f"doc_id string, status string, po {PO_SCHEMA}, error string").alias("o")).select("o.*")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Run settings; unknown keys make the row's `unknown` non-empty."""
    allowed = [c.split()[0] for c in CONFIG_SCHEMA.replace("map<string,string>", "m").split(", ")]
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.from_json("value", CONFIG_SCHEMA).alias("c"),
        F.array_except(F.json_object_keys("value"), F.array(*[F.lit(k) for k in allowed])).alias("unknown"),
    ).select("c.*", "unknown")


def read_raw_calls(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Every call's raw answer, from one JSON document per file, or per line with its doc_id."""
    raw = spark.read.text(path, wholetext=not lines).withColumn("file", _doc_of(F.input_file_name()))
    parsed = raw.select("file", F.from_json("value", f"doc_id string, calls {CALL_SCHEMA}").alias("r"))
    return parsed.select((F.col("r.doc_id") if lines else F.col("file")).alias("doc_id"), F.inline("r.calls"))


def read_masters(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parties, items, processed numbers), each a JSON file or, as `write_masters` leaves them, JSON lines."""
    parties = spark.read.schema("gstin string, name string, state_code string, role string, party_id string").json(
        f"{folder}/parties.json", multiLine=not lines
    )
    items = spark.read.schema(
        "issuer_id string, issuer_gstin string, item_code string, description string, hsn_sac string, uom string"
    ).json(f"{folder}/items.json", multiLine=not lines)
    entry = "struct<issuer_id:string,issuer_name:string,po_numbers:array<string>>"
    processed = spark.read.text(f"{folder}/processed_po_numbers.json", wholetext=not lines).select(
        F.explode(F.from_json("value", f"map<string,{entry}>")).alias("issuer_gstin", "entry")
    ).select("issuer_gstin", F.explode("entry.po_numbers").alias("po_number"))
    return parties, items, processed


def index_masters(items: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item codes and processed numbers by the PAN inside the GSTIN."""
    from poledger.functions.gst import pan_of
    from poledger.functions.normal import key_text

    by_pan = pan_of(F.col("issuer_gstin")).alias("pan")
    return index_items(items), processed.select(by_pan, key_text(F.col("po_number")).alias("number")).distinct()


def index_items(items: DataFrame) -> DataFrame:
    """Item codes by the PAN inside the GSTIN."""
    from poledger.functions.gst import pan_of

    return items.select(pan_of(F.col("issuer_gstin")).alias("pan"), "item_code").distinct()


def write_masters(parties: DataFrame, items: DataFrame, processed: DataFrame, folder: str,
                  compression: str | None = None) -> None:
    """JSON lines, parties sorted by GSTIN across files (a range-partitioned sort, no single writer). A
    number is a line of its own, so no issuer's numbers are gathered."""
    parties.orderBy("gstin").write.json(f"{folder}/parties.json", compression=compression)
    items.write.json(f"{folder}/items.json", compression=compression)
    entry = F.create_map("issuer_gstin", F.struct(F.array("po_number").alias("po_numbers")))
    processed.orderBy("issuer_gstin", "po_number").select(F.to_json(entry).alias("value")).write.text(f"{folder}/processed_po_numbers.json", compression=compression)


COMMIT_SCHEMA = "run_id string, number long, version string, tables array<string>"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commit that counts for each run: the last one."""
    try:
        rows = spark.read.schema(COMMIT_SCHEMA).json(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], COMMIT_SCHEMA)
    last = F.max_by(F.struct("number", "version", "tables"), F.struct("number", "version"))
    return rows.groupBy("run_id").agg(last.alias("c")).select("run_id", "c.*")


def _commit(spark: SparkSession, root: str, run_id: str):
    return commits(spark, root).filter(F.col("run_id") == run_id).first()


def _version(root: str, run_id: str, version: str) -> str:
    return f"{root}/run_id={run_id}/version={version}"


def stage_run(tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Writes the tables under a new version that no reader sees yet."""
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{_version(root, run_id, version)}/{name}")
    return version


def write_run(tables: dict[str, DataFrame], root: str, run_id: str, overwrite: bool = False) -> str:
    """All tables of a run (config, records, outputs, raw calls), published by one commit row written last.
    A run that exists is refused unless `overwrite`; without a commit there is no run to overwrite."""
    spark = next(iter(tables.values())).sparkSession
    before = _commit(spark, root, run_id)
    if before is not None and not overwrite:
        raise FileExistsError(f"run exists: {run_id}")
    if before is None and overwrite:
        raise FileNotFoundError(f"no run to overwrite: {run_id}")
    version = stage_run(tables, root, run_id)
    row = (run_id, 1 if before is None else before["number"] + 1, version, sorted(tables))
    spark.createDataFrame([row], COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/commits")
    return version


def read_run(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """A table of the committed version of a run."""
    found = _commit(spark, root, run_id)
    if found is None or name not in found["tables"]:
        raise FileNotFoundError(f"no table {name} of a committed run {run_id}")
    return spark.read.parquet(f"{_version(root, run_id, found['version'])}/{name}")


def config_row(spark: SparkSession, **settings) -> DataFrame:
    """The settings of a run as one row; an unknown key is refused."""
    names = [c.split()[0] for c in CONFIG_SCHEMA.replace("map<string,string>", "m").split(", ")]
    if unknown := set(settings) - set(names):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return spark.createDataFrame([tuple(settings.get(n) for n in names)], CONFIG_SCHEMA)


def error_file(errors: DataFrame) -> DataFrame:
    """The eight columns of the error file, most frequent field first; absent values are empty. Errors with
    `run_doc` and `variant` are those of single run documents."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fuzzy = F.coalesce(F.round("fuzzy", 1).cast("string"), F.lit("")) if "fuzzy" in errors.columns else F.lit("")
    return scoring.by_frequency(errors).select(
        *([F.col("run_doc").alias("doc_id"), "variant"] if "run_doc" in errors.columns
          else [F.concat(F.lit("PO_"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("N").alias("variant")]),
        "field", "outcome", text("row").alias("row"), text("truth").alias("truth"), text("pred").alias("pred"),
        fuzzy.alias("fuzzy"),
    )


def write_errors(errors: DataFrame, path: str, compression: str | None = None) -> None:
    error_file(errors).write.csv(path, header=True, emptyValue="", compression=compression)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in ("doc_id", "variant", "field", "outcome", "row", "truth", "pred", "fuzzy"))
    return spark.read.csv(path, header=True, schema=schema).fillna("")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Each file's SHA-256 is its id."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")
