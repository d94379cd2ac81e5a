"""Raw answers to typed purchase orders: parse, decode, repair, de-duplicate, type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poledger.functions.constants import text_map, texts
from poledger.functions.dates import parse_date
from poledger.functions.once import once
from poledger.refdata import (
    CRITICAL_HEADER_FIELDS,
    HEADER_FIELDS,
    HEADER_KIND,
    LINE_COLUMNS,
    LINE_TYPE,
    ROW_COLUMNS,
    SHORT_TO_FULL,
    header_sql_type,
)

THINK = r"(?sU)\A\s*<think>(.*?)</think>"
FENCE = r"(?sU)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z"
TAX_TOTALS = ("cgst_total", "sgst_total", "igst_total")


def split_reasoning(calls: DataFrame) -> DataFrame:
    """answer = content after a leading think block; reasoning = the given text, else the block's."""
    block = F.nullif(F.trim(F.regexp_extract("content", THINK, 1)), F.lit(""))
    return calls.withColumn("thought", F.coalesce(F.nullif("reasoning", F.lit("")), block)).withColumn(
        "answer", F.regexp_replace("content", THINK, "")
    )


def parse_answers(calls: DataFrame) -> DataFrame:
    """Adds answer, thought, ok and error_kind (transient/api from the request, truncated,
    invalid_json)."""
    c = split_reasoning(calls)
    keys = F.json_object_keys("answer")
    is_object = keys.isNotNull()
    # a repeated key is no error: the last one counts
    is_json = F.try_parse_json("answer").isNotNull() | (F.size(keys) > F.size(F.array_distinct(keys)))
    kind = (
        F.when(F.col("request_error").isNotNull(), F.col("request_error"))
        .when(F.col("finish_reason") == "length", "truncated")
        .when(~is_json | ~is_object, "invalid_json")
    )
    return c.withColumn("error_kind", kind).withColumn("ok", F.col("error_kind").isNull())


def parse_baseline(calls: DataFrame) -> DataFrame:
    """Single-answer runs: a code fence is stripped; completed / parse_error / failed, and whether
    a JSON object was kept."""
    c = split_reasoning(calls)
    body = F.when(F.col("answer").rlike(FENCE), F.regexp_extract("answer", FENCE, 1)).otherwise(F.col("answer"))
    c = c.withColumn("body", body)
    is_object = F.json_object_keys("body").isNotNull() & F.try_parse_json("body").isNotNull()
    full = F.from_json("body", "map<string,string>")
    short = {f: s for s, f in SHORT_TO_FULL.items()}
    complete = is_object
    for f in CRITICAL_HEADER_FIELDS:
        complete = complete & F.coalesce(F.try_element_at(full, F.lit(short[f])), F.try_element_at(full, F.lit(f))).isNotNull()
    return c.withColumn(
        "status",
        F.when(F.col("request_error").isNotNull(), "failed").when(complete, "completed").otherwise("parse_error"),
    ).withColumn("kept", F.col("request_error").isNull() & F.coalesce(is_object, F.lit(False)))


def reasoning_tokens(calls: DataFrame) -> DataFrame:
    """Reported if positive or nothing was thought; else the thought's share of the characters."""
    c = split_reasoning(calls)
    thought, reported = F.length("thought"), F.col("reported_reasoning")
    usable = reported.isNotNull() & ((reported > 0) | F.col("thought").isNull())
    share = F.bround(F.col("completion_tokens") * thought / (thought + F.length("answer")), 0).cast("bigint")
    return c.withColumn("reasoning_tokens", F.when(usable, reported).otherwise(share)).withColumn(
        "estimated", ~usable & F.col("thought").isNotNull()
    )


def _key_map() -> Column:
    return text_map(SHORT_TO_FULL)


def rename_keys(answers: DataFrame) -> DataFrame:
    """(doc_id, call_id, key, field, known, value) of header answers, one row per key; unknown
    keys keep their name. `known=false` rows are what the strict form refuses."""
    exploded = answers.select("doc_id", "call_id", F.explode(F.from_json("answer", "map<string,string>")).alias("key", "value"))
    field = F.try_element_at(_key_map(), F.col("key"))
    return exploded.select("doc_id", "call_id", "key", F.coalesce(field, "key").alias("field"),
                           field.isNotNull().alias("known"), "value")


def _cast(kind: str, v: Column) -> Column:
    # only the form that is asked for is built: a date has hundreds of expressions
    return parse_date(v) if kind == "date" else v.try_cast("decimal(18,2)") if kind == "money" else v


def _by_full_name(answers: DataFrame) -> DataFrame:
    """(doc_id, m): the answer's values by full field name; of several keys with one full name the last counts."""
    given = once(answers.select("doc_id", "answer"), given=F.from_json("answer", "map<string,string>"))
    key_map = _key_map()
    names = F.transform(F.map_keys("given"), lambda k: F.coalesce(F.try_element_at(key_map, k), k))
    named = once(given.select("doc_id", "given"), names=names, vals=F.map_values("given"))
    last = F.filter(
        F.arrays_zip("names", "vals"),
        lambda e, i: F.array_position(F.slice("names", i + 2, F.size("names")), e["names"]) == 0,
    )
    unique = F.size(F.array_distinct("names")) == F.size("names")
    m = F.when(unique, F.map_from_arrays("names", "vals")).otherwise(F.map_from_entries(last))
    return once(named, m=m).select("doc_id", "m")


def _whole(c: Column) -> Column:
    """A whole number, also when it is written with a fraction of zero (17.0)."""
    d = F.trim(c).try_cast("decimal(20,4)")
    return F.when(d == F.floor(d), d).try_cast("int")


def typed_header(answers: DataFrame) -> DataFrame:
    """doc_id, the typed fields, and errors (field, error) of what was not taken, each value read once.

    The answer's keys stay in one row as a map, so typing needs no unpivot and no shuffle.
    """
    value = {f: F.try_element_at("m", F.lit(f)) for f in HEADER_FIELDS}
    cells = {}
    for f in HEADER_FIELDS:
        c = _cast(HEADER_KIND[f], value[f])
        if f in TAX_TOTALS:
            c = F.when(value[f].isNull(), F.lit(0).cast("decimal(18,2)")).otherwise(c)
        cells[f] = c.cast(header_sql_type(f))
    typed = once(_by_full_name(answers), **cells)
    bad = [
        F.when(value[f].isNotNull() & F.col(f).isNull(),
               F.struct(F.lit(f).alias("field"), F.lit(f"not a {HEADER_KIND[f]} value").alias("error")))
        for f in HEADER_FIELDS if HEADER_KIND[f] != "text"
    ]
    unknown = F.transform(
        F.array_except(F.map_keys("m"), texts(HEADER_FIELDS)),
        lambda k: F.struct(k.alias("field"), F.lit("unknown field").alias("error")),
    )
    errors = F.concat(F.filter(F.array(*bad), lambda e: e.isNotNull()), unknown)
    return typed.select("doc_id", *HEADER_FIELDS, errors.alias("errors"))


def header_parts(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, header errors) of typed headers."""
    return typed.drop("errors"), typed.select("doc_id", F.inline("errors"))


def merge_header(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed header, header errors). One bad value never hides the others; absent tax totals are
    0.00 once there is a header answer."""
    return header_parts(typed_header(answers))


# --- line items ------------------------------------------------------------------------------
def split_rows(answers: DataFrame) -> DataFrame:
    """(doc_id, call_id, page_no, idx, row, cells): the rows of line-item answers, each read once.

    Rows come out of the answer in two steps, so one malformed row never nulls its neighbours.
    """
    raw = once(answers.select("doc_id", "call_id", "page_no", "answer"), rows=F.from_json("answer", "rows array<string>")["rows"])
    r = raw.select("doc_id", "call_id", "page_no", F.posexplode("rows").alias("idx", "row"))
    return once(r, cells=F.from_json("row", "array<string>"))


def decode_rows(answers: DataFrame, widths: tuple[int, ...] = (len(ROW_COLUMNS),)) -> tuple[DataFrame, DataFrame]:
    """(rows, row errors) of line-item answers, as row_parts gives them."""
    return row_parts(split_rows(answers), widths)


def row_parts(r: DataFrame, widths: tuple[int, ...] = (len(ROW_COLUMNS),)) -> tuple[DataFrame, DataFrame]:
    """(rows, row errors) of split rows. A row is an array of 12 cells (15 in the full form,
    where `widths` allows it); anything else is a row error naming the cell count or the kind of value.
    """
    # What is no array parses to a one-cell array in permissive mode.
    is_array = F.ltrim("row").startswith("[")
    n = F.when(is_array, F.size("cells"))
    good = n.isin(*widths)
    def pick(name: str) -> Column:
        short = F.get("cells", F.lit(ROW_COLUMNS.index(name))) if name in ROW_COLUMNS else F.lit(None).cast("string")
        return F.when(n == len(ROW_COLUMNS), short).otherwise(F.get("cells", F.lit(LINE_COLUMNS.index(name)))).alias(name)

    rows = r.filter(good).select("doc_id", "call_id", "page_no", "idx", *[pick(c) for c in LINE_COLUMNS])
    kind = (
        F.when(F.col("row").isNull(), "NoneType")
        .when(F.ltrim("row").startswith("{"), "dict")
        .when(F.col("row").isin("true", "false"), "bool")
        .when(F.col("row").rlike(r"\A-?[0-9]+\z"), "int")
        .when(F.col("row").try_cast("double").isNotNull(), "float")
        .otherwise("str")
    )
    size = F.coalesce(n.cast("string"), kind)
    errors = r.filter(~F.coalesce(good, F.lit(False))).select(
        "doc_id", "call_id", "page_no", "idx",
        F.concat(F.lit(f"expected {len(ROW_COLUMNS)} cells, got "), size).alias("message"),
    )
    return rows, errors


def first_bad_row(errors: DataFrame) -> DataFrame:
    """Strict form: the first malformed row of each answer."""
    return errors.groupBy("doc_id", "call_id").agg(F.min(F.struct("idx", "message")).alias("e")).select(
        "doc_id", "call_id", "e.idx", "e.message"
    )


def join_fragments(rows: DataFrame) -> DataFrame:
    """Continuation fragments (no number, no quantity, first in their answer) folded into the
    last whole row before them.

    The first row of a document is a head whatever its shape. Only one row per answer can be a
    fragment and only the last row of an answer can take one, so a window over answers (not rows) finds each fragment's head; whole rows that take no
    fragment never shuffle for it.
    """
    frag = F.col("line_no").isNull() & F.col("quantity").isNull() & (F.col("idx") == 0)
    cells = [c for c in LINE_COLUMNS]
    per_call = rows.groupBy("doc_id", "page_no").agg(
        F.max(F.when(~frag, F.struct("page_no", "idx"))).alias("last_head"),
        F.bool_or(frag).alias("has_fragment"),
        F.min(F.when(frag, F.struct("page_no", "idx"))).alias("fragment"),
    )
    by_page = Window.partitionBy("doc_id").orderBy("page_no")
    opens = F.row_number().over(by_page) == 1
    per_call = per_call.withColumn("opens", opens).select(
        "doc_id", "page_no", (F.col("has_fragment") & ~F.col("opens")).alias("has_fragment"),
        F.coalesce("last_head", F.when(F.col("opens"), F.col("fragment"))).alias("last_head"),
    )
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    heads = per_call.withColumn("head", F.max("last_head").over(before)).filter("has_fragment and head is not null")
    taken = rows.filter(frag).join(heads.select("doc_id", "page_no", "head"), ["doc_id", "page_no"])
    pieces = taken.groupBy("doc_id", F.col("head.page_no").alias("page_no"), F.col("head.idx").alias("idx")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.nullif("description", F.lit("")).alias("d")))), lambda s: s["d"]), " "
        ).alias("more"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page_no"))).alias(f"f_{c}") for c in cells if c != "description"],
    )
    whole = rows.join(taken.select("doc_id", "page_no", "idx"), ["doc_id", "page_no", "idx"], "left_anti")
    j = whole.join(pieces, ["doc_id", "page_no", "idx"], "left")
    description = F.when(
        F.length("more") > 0, F.trim(F.concat_ws(" ", F.coalesce("description", F.lit("")), "more"))
    ).otherwise(F.col("description"))
    filled = [
        (description if c == "description" else F.coalesce(c, f"f_{c}")).alias(c) for c in cells
    ]
    return j.select("doc_id", "call_id", "page_no", "idx", *filled)


def dedupe_rows(rows: DataFrame) -> DataFrame:
    """One row per line number: most filled cells, then longest description, then first. Rows
    without a number all stay."""
    number = _whole(F.col("line_no"))
    filled = F.lit(0)
    for c in LINE_COLUMNS:
        filled = filled + F.col(c).isNotNull().cast("int")
    keyed = rows.withColumn("key", F.coalesce(number.cast("string"), "line_no")).withColumn("filled", filled)
    w = Window.partitionBy("doc_id", "key").orderBy(
        F.desc("filled"), F.desc(F.length(F.coalesce("description", F.lit("")))), "page_no", "idx"
    )
    best = keyed.filter("key is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return best.unionByName(keyed.filter("key is null"))


def type_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed lines, row errors): a row needs its eight critical columns, all of the right type."""
    from poledger.refdata import CRITICAL_LINE_COLUMNS

    def typed(c: str) -> Column:
        t = LINE_TYPE[c]
        if t == "int":
            return _whole(F.col(c))
        return F.col(c) if t == "string" else parse_date(F.col(c)) if t == "date" else F.trim(c).try_cast(t)

    first_bad = F.coalesce(*[
        F.when(F.col(c).isNull(), f"{c}: Field required") if c in CRITICAL_LINE_COLUMNS and LINE_TYPE[c] == "string"
        else F.when(F.col(c).isNull(), f"{c}: Field required").when(typed(c).isNull(), f"{c}: invalid value")
        if c in CRITICAL_LINE_COLUMNS
        else F.when(F.col(c).isNotNull() & typed(c).isNull(), f"{c}: invalid value")
        for c in LINE_COLUMNS
    ])
    r = rows.withColumn("message", first_bad)
    good = r.filter("message is null").select("doc_id", "call_id", "page_no", "idx", *[typed(c).alias(c) for c in LINE_COLUMNS])
    bad = r.filter("message is not null").select(
        "doc_id", "call_id", _whole(F.col("line_no")).alias("line_no"), "message", "page_no", "idx"
    )
    return good, bad


def missing_calls(calls: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned calls without a usable answer: failed, unparsable, or lines without a row list."""
    rows = F.get_json_object("answer", "$.rows")
    usable = F.col("ok") & ((F.col("call_id") == "H") | F.coalesce(F.ltrim(rows).startswith("["), F.lit(False)))
    return planned.select("doc_id", "call_id").join(
        calls.filter(usable).select("doc_id", "call_id"), ["doc_id", "call_id"], "left_anti"
    )


def best_answer(calls: DataFrame) -> DataFrame:
    """A retried call that succeeded replaces the first answer; otherwise the first stays."""
    rank = F.when((F.col("attempt") == "retry") & F.col("ok"), 0).when(F.col("attempt") == "first", 1).otherwise(2)
    # of several answers of one rank the latest, where the table says which that is
    latest = [F.desc(c) for c in ("ended_at", "attempt_no") if c in calls.columns]
    w = Window.partitionBy("doc_id", "call_id").orderBy(rank, *latest, F.md5("content"))
    return calls.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").filter(
        (F.col("attempt") == "first") | F.col("ok")
    )


def complete_pos(header: DataFrame) -> DataFrame:
    """Documents whose critical header values are all there, as complete orders."""
    missing = [F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(CRITICAL_HEADER_FIELDS)]
    gone = F.concat_ws(",", *missing)
    return header.select("doc_id", (gone == "").alias("complete"), gone.alias("missing"))
