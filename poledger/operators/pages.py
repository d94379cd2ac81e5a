"""Page text to features: kind, skippable pages, identifiers, row estimates, grounding.

Input everywhere: page_text(doc_id, page_no, text). Nothing gathers a document's pages into
one row: hits stay rows, and what a pattern needs across a page break (the last words of the
page before) travels as a short string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poledger.functions import gst, printing
from poledger.functions.dates import parse_date
from poledger.functions.normal import key_text
from poledger.functions.once import once
from poledger.plans.staging import settle
from poledger.refdata import GROUNDED_HEADER_FIELDS, NATIVE_MIN_CHARS

# --- Fixed values: patterns of the page rules ------------------------------------------------
# (?d): only \n ends a line; (?U): Unicode classes.
TC_HEADING = r"(?imdU)^.{0,25}\bterms\s*(?:&|and)\s*conditions\b.{0,20}$"
CLAUSE = r"(?imdU)^\s*(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]\s+\S"
MIN_CLAUSES = 3
BLOCKERS = (
    r"(?U)\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b",
    r"(?U)(?:₹|\bRs\.?|\bINR)\s*\d",
    r"(?iU)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b\d{1,2}[- ](?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-, ]+\d{2,4}\b",
    r"(?imdU)^\s*(?:\d{1,2}[.)]\s*)?(?:payment|price basis|delivery|freight|mode of|despatch"
    r"|dispatch|transport|place of delivery|packing|warranty|guarantee|validity)"
    r"\b[^:\n]{0,30}:",
)
MONEY = r"(?U)\b\d{1,3}(?:,\d{2,3})*\.\d{2}\b"
QTY_WORD = r"(?iU)\b(?:qty|quantity)\b"
ITEM_WORD = r"(?iU)\b(?:hsn|rate|uom|unit price)\b"
SKIP_REASON = "a page of clauses without order data"
SERIAL = r"(?md)^[ \t]*([0-9]{1,3})(?:[ \t]|$)"

# --- Fixed values: patterns of the identifier hints ------------------------------------------
GSTIN_LIKE = r"(?i)(?<![A-Z0-9])[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{3}(?![A-Z0-9])"
PAN_LIKE = r"(?i)(?<![A-Z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Z0-9])"
# \\G and the look-behind only spare re-reading the rest of a run that has no @.
EMAIL = r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}"
_NUMBER = (
    r"(?:\+91[ -]?|0)?(?:[0-9]{10}|[0-9]{5}[ -][0-9]{5}|[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}"
    r"|0[0-9]{2,4}[ -][0-9]{6,8})"
)
_NUMBER_END = r"(?![\w,/-]|\.[0-9])"
# Groups: 1 the 25 characters before, 2 the number, 3 the rest of its line. The number is looked for before
# the look-behind, which would try 26 places at each figure of a page.
PHONE = (
    rf"(?sU)(?=[+0-9])(?<![\w.,/+-])(?={_NUMBER}{_NUMBER_END})(?<=(\A.{{0,24}}|.{{25}}))"
    rf"({_NUMBER}){_NUMBER_END}(?=([^\n]*))"
)
PHONE_LABEL = (
    r"(?iU)\b(?:ph(?:one)?|tel(?:ephone)?|mob(?:ile)?|cell|contact(?:\s*no)?)\b[^\n]{0,3}\W*\z"
)
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE = (
    r"(?i)(?<![0-9])(?<![0-9][/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{2})"
    rf"|[0-9]{{1,2}}(?:st|nd|rd|th)?[ /.-]*{_MONTH},?[ /.-]*[0-9]{{4}}"
    rf"|(?U:\b){_MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}"
    r")(?![0-9]|[/.-][0-9])"
)
HSN_ALONE = (
    r"(?iU)(?<![\w,./:#-])(?<!- )(?<!PIN )([0-9]{6}|[0-9]{8})(?![\w,/:-]|\.[0-9])"
)
HSN_LABELLED = (
    r"(?iU)\b(?:HSN|SAC)(?:/SAC)?(?:\s*(?:code|no\.?))?\s*[:-]?\s*([0-9]{4}|[0-9]{6}|[0-9]{8})\b"
)
NO_HSN_CHAPTERS = ("00", "77")
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2003\u3000"
LINES = 128  # lines in a block, and blocks in a group, of the line scan
BREAK = "\u0001"  # between tokens of a grounding corpus
ANYWHERE = 8  # characters from which a value matches inside tokens too
BLOCK = 4096  # characters of a document that are searched at a time
SEED, STRIDE = 5, 4  # every value that matches anywhere holds SEED characters at a strided place


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def skip_reason(text: Column) -> Column:
    """Why a page carries no field: a terms heading with clauses and nothing that blocks."""
    blocked = reduce(lambda a, b: a | b, [text.rlike(p) for p in BLOCKERS])
    return F.when(
        text.rlike(TC_HEADING)
        & (_count(text, CLAUSE) >= MIN_CLAUSES)
        & ~blocked
        & (_count(text, MONEY) < 2)
        & ~(text.rlike(QTY_WORD) & text.rlike(ITEM_WORD)),
        SKIP_REASON,
    )


def page_features(pages: DataFrame, native_mode: str = "text+image",
                  min_chars: int = NATIVE_MIN_CHARS) -> DataFrame:
    """kind, skip_reason, kept, layer (the text sent, null if none), needs_image."""
    # more than min_chars letters: the match ends with the first that is too many
    native = F.col("text").rlike(rf"(?U)\A(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{min_chars + 1}}}")
    p = once(pages, kind=F.when(native, "native").otherwise("scanned"))
    reason = F.when((F.col("kind") == "native") & (F.col("page_no") > 1), skip_reason(F.col("text")))
    p = once(p, skip_reason=reason).withColumn("kept", F.col("skip_reason").isNull())
    has_layer = F.col("kept") & (F.col("kind") == "native") & F.lit(native_mode != "image")
    layer = F.btrim(F.col("text"), F.lit(BLANKS))
    return p.withColumn("layer", F.when(has_layer, layer)).withColumn(
        "needs_image",
        F.col("kept") & ((F.col("kind") == "scanned") | F.lit(native_mode != "text")),
    )


# --- rows per page ---------------------------------------------------------------------------
def estimate_rows(text: Column) -> Column:
    """Longest chain n, n+1, ... of line-start serials in reading order.

    State: best chain ending at each distinct serial (at most 999 of them).
    """
    serials = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(SERIAL), F.lit(1)), lambda s: s.cast("int")
        ),
        lambda n: n > 0,
    )
    distinct = F.array_distinct(serials)
    start = F.transform(distinct, lambda n: F.lit(0))

    def step(best: Column, n: Column) -> Column:
        place = F.array_position(distinct, n)
        before = F.coalesce(F.get(best, F.array_position(distinct, n - 1).cast("int") - 1), F.lit(0))
        return F.transform(
            best, lambda v, i: F.when(i + 1 == place, F.greatest(v, before + 1)).otherwise(v)
        )

    return F.coalesce(F.array_max(F.aggregate(serials, start, step)), F.lit(0))


def page_rows(features: DataFrame) -> DataFrame:
    """Kept pages with their estimated rows (null without a text layer)."""
    return features.filter("kept").select(
        "doc_id", "page_no", "kind",
        F.when(F.col("layer").isNotNull(), estimate_rows(F.col("layer"))).alias("rows"),
    )


def item_pages(rows: DataFrame) -> DataFrame:
    """Pages with rows, pages without text, or every kept page when no text shows a row.

    Two narrow aggregates joined on the document, so no window holds a document's pages.
    """
    best = rows.groupBy("doc_id").agg(F.max("rows").alias("best"))
    return (
        rows.join(best, "doc_id")
        .filter((F.coalesce(F.col("best"), F.lit(0)) == 0) | F.coalesce(F.col("rows") > 0, F.lit(True)))
        .select("doc_id", "page_no", "rows")
    )


# --- identifier hints ------------------------------------------------------------------------
def _with_carry(pages: DataFrame) -> DataFrame:
    """scan = the page's text after the last two worded lines of the text page before it, so a
    label at the foot of a page still meets its number on the next.

    Pages with the lowest number have none before them, so their text is not shuffled; feet travel only
    in documents with a later page.
    """
    lowest = pages.filter("page_no < 1").agg(F.min("page_no")).first()[0]
    later = F.col("page_no") > (1 if lowest is None else lowest)
    lines = once(pages.select("doc_id", "page_no", "layer"), lines=F.split("layer", "\n"))
    numbers = F.transform("lines", lambda line, i: F.when(line.rlike(r"(?U)\w"), i))
    worded = once(lines, worded=F.filter(numbers, lambda i: i.isNotNull()))
    start = F.coalesce(F.get("worded", F.size("worded") - 2), F.get("worded", F.size("worded") - 1), F.lit(0))
    tail = F.array_join(F.slice("lines", start + 1, F.size("lines")), "\n")
    several = pages.filter(later).select("doc_id").distinct()
    tails = worded.select("doc_id", "page_no", tail.alias("tail")).join(several, "doc_id", "left_semi")
    by_page = Window.partitionBy("doc_id").orderBy("page_no")
    carry = tails.withColumn("carry", F.lag("tail").over(by_page)).filter(
        F.col("carry").isNotNull()
    )
    met = pages.filter(later).join(carry.select("doc_id", "page_no", "carry"), ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", F.concat_ws("\n", "carry", "layer").alias("scan")
    )
    return pages.filter(~later).select("doc_id", "page_no", F.col("layer").alias("scan")).unionByName(met)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def phones(text: Column) -> Column:
    """+91 numbers, labelled numbers, and numbers alone on their line; digits only."""
    # Blank runs are cut to 24: a run that long already pushes any label (two letters or more) out
    # of the 25 characters before, and then those 25 also show whether the line starts blank.
    t = F.concat(F.lit("\n"), F.regexp_replace(text, r"(?U)([^\S\n]{24})[^\S\n]+", "$1"))
    hits = F.arrays_zip(
        _all(t, PHONE, 1).alias("before"), _all(t, PHONE, 2).alias("number"), _all(t, PHONE, 3).alias("rest")
    )
    kept = F.filter(
        hits,
        lambda h: h["number"].startswith("+91")
        | h["before"].rlike(PHONE_LABEL)
        | (h["before"].rlike(r"(?U)\n[^\S\n]*\z") & ~h["rest"].rlike(r"(?U)\S")),
    )
    return F.transform(
        kept,
        lambda h: F.concat(
            F.when(h["number"].startswith("+"), "+").otherwise(""),
            F.regexp_replace(h["number"], r"\D", ""),
        ),
    )


def _hint_values(text: Column) -> dict[str, list[Column]]:
    """Per kind, value arrays in rank order."""
    up = lambda a: F.transform(a, F.upper)
    hsn = lambda a: F.filter(a, lambda c: ~F.left(c, F.lit(2)).isin(*NO_HSN_CHAPTERS))
    return {
        "gstin": [up(_all(text, GSTIN_LIKE))],
        "pan": [F.filter(up(_all(text, PAN_LIKE)), gst.is_valid_pan)],
        "email": [F.transform(_all(text, EMAIL), F.lower)],
        "phone": [phones(text)],
        "date": [
            F.filter(
                F.transform(_all(text, DATE), lambda d: parse_date(d).cast("string")),
                lambda d: d.isNotNull(),
            )
        ],
        "hsn": [hsn(_all(text, HSN_ALONE, 1)), hsn(_all(text, HSN_LABELLED, 1))],
    }


def _tagged(values: Column, kind: str, part: int) -> Column:
    return F.transform(
        values,
        lambda v, i: F.struct(
            F.lit(kind).alias("kind"), v.alias("value"), F.lit(part).alias("part"), i.alias("i")
        ),
    )


def hints(features: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, kind, value, first_page, valid): distinct identifiers with where they first stand.

    All kinds come from one pass over the text; the distinct is a plain aggregate, so repeats
    on a page or in a huge document fold before the shuffle.
    """
    texts = features.filter("kept and layer <> ''").select("doc_id", "page_no", "layer")
    scan = _with_carry(texts)
    groups = []
    for kind, arrays in _hint_values(F.col("scan")).items():
        if kinds and kind not in kinds:
            continue
        for part, arr in enumerate(arrays):
            groups.append(_tagged(arr, kind, part))
    hit = scan.select("doc_id", "page_no", F.inline(F.flatten(F.array(*groups))))
    first = hit.groupBy("doc_id", "kind", "value").agg(
        F.min(F.struct("part", "page_no", "i")).alias("first")
    )
    return first.select(
        "doc_id", "kind", "value", F.col("first.page_no").alias("first_page"),
        F.when(F.col("kind") == "gstin", gst.is_valid_gstin(F.col("value")))
        .otherwise(F.lit(True)).alias("valid"),
    )


# --- grounding -------------------------------------------------------------------------------
def grounding_values(header: DataFrame, lines: DataFrame) -> DataFrame:
    """Identifiers to look up, with the page they were read from where known."""
    head = header.select(
        "doc_id",
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(None).cast("int").alias("line_no"),
                     F.col(f).alias("value"), F.lit(1).alias("page_no"))
            for f in GROUNDED_HEADER_FIELDS
        ])),
    )
    page = F.try_element_at(
        F.transform(F.regexp_extract_all("call_id", F.lit(r"\ALI-p(\d+)\z"), F.lit(1)), lambda p: p.cast("int")),
        F.lit(1),
    )
    rows = lines.select(
        "doc_id",
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col("line_no"), F.col(f).alias("value"), page.alias("page_no"))
            for f in ("item_code", "hsn_sac")
        ])),
    )
    return head.unionByName(rows).filter("value is not null and value <> ''")


def _printed(needle: Column, stream: Column) -> Column:
    """Eight characters or more match anywhere; shorter values on token boundaries, where they
    may span tokens (an optional break between any two characters)."""
    spaced = F.regexp_replace(needle, "(?<=.)(?=.)", f"{BREAK}?")
    return F.when(
        F.length(needle) >= ANYWHERE, F.contains(F.replace(stream, F.lit(BREAK), F.lit("")), needle)
    ).otherwise(F.regexp_like(stream, F.concat(F.lit(BREAK), spaced, F.lit(BREAK))))


def _blocks(stream: DataFrame, size: int) -> DataFrame:
    """(doc_id, block, before, text, after): the token stream of each document, its pages one after
    another, cut into blocks of `size` characters, with the neighbours of each. Only lengths meet in
    a document's window; a block gathers at most `size` pieces."""
    body = stream.select("doc_id", "page_no", F.substring("stream", 2, 1 << 30).alias("body"))
    sizes = body.select("doc_id", "page_no", F.length("body").cast("bigint").alias("n"))
    ahead = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = body.join(sizes.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))), ["doc_id", "page_no"])
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {size}, (start + n - 1) div {size})")))
    skip = F.greatest(F.col("block") * size - F.col("start"), F.lit(0))
    stop = F.least((F.col("block") + 1) * size - F.col("start"), F.col("n"))
    piece = F.substring("body", (skip + 1).cast("int"), (stop - skip).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))), lambda p: p["piece"]), "")
    own = settle(cut.groupBy("doc_id", "block").agg(text.alias("text")), "stream-blocks")
    seen = [own.select("doc_id", (F.col("block") + d).alias("block"), F.lit(d).alias("d"), "text") for d in (-1, 0, 1)]
    side = lambda d: F.max(F.when(F.col("d") == d, F.col("text")))
    met = reduce(DataFrame.unionByName, seen).groupBy("doc_id", "block").agg(side(0).alias("text"), side(1).alias("before"), side(-1).alias("after"))
    return met.filter("text is not null").select(
        "doc_id", "block", "text", F.coalesce("before", F.lit(BREAK)).alias("before"), F.coalesce("after", F.lit("")).alias("after")
    )


def _text_seeds(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, seed): SEED characters from every STRIDE-th one on, for values that match anywhere,
    and the first one to four characters of each token, for values that match on token boundaries."""
    bare = lambda c: F.replace(c, F.lit(BREAK), F.lit(""))
    ahead = F.substring("after", 1, 4 * SEED)
    whole, own = bare(F.concat("text", ahead)), F.length(bare(F.col("text")))
    strided = F.when(own > 0, F.transform(F.sequence(F.lit(0), own - 1, F.lit(STRIDE)), lambda i: F.concat(F.lit("any "), F.substring(whole, i + 1, SEED))))
    heads = F.regexp_extract_all(F.concat(F.right("before", F.lit(1)), F.col("text"), ahead), F.lit(f"(?<={BREAK})(?=((?:[^{BREAK}]{BREAK}?){{1,4}}))"), F.lit(1))
    tokens = F.flatten(F.transform(heads, lambda h: F.transform(F.sequence(F.lit(1), F.length(bare(h))), lambda k: F.concat(F.lit("token "), F.substring(bare(h), 1, k)))))
    return blocks.select("doc_id", "block", F.explode(F.array_distinct(F.concat(F.coalesce(strided, F.array().cast("array<string>")), tokens))).alias("seed"))


def _value_seeds(needles: DataFrame) -> DataFrame:
    """(doc_id, needle, seed): one of a long value's first STRIDE seeds stands at a strided place."""
    any_ = F.array(*[F.concat(F.lit("any "), F.substring("needle", o + 1, SEED)) for o in range(STRIDE)])
    return needles.select("doc_id", "needle", F.explode(F.when(F.length("needle") >= ANYWHERE, any_).otherwise(F.array(F.concat(F.lit("token "), F.substring("needle", 1, 4))))).alias("seed"))


def search(needles: DataFrame, stream: DataFrame) -> DataFrame:
    """(doc_id, needle) of the needles that their document prints, over any number of page breaks.

    The values of a document of one block meet that block. In longer ones seeds of values meet equal seeds
    of blocks of the text in a join on (document, seed); only blocks with a seed are searched, each with both neighbours, and blocks are longer than any value.
    """
    longest = needles.agg(F.max(F.length("needle"))).first()[0] or 0
    size = max(BLOCK, 2 * longest + 2)
    texts = stream.join(needles.select("doc_id").distinct(), "doc_id", "left_semi")
    blocks = settle(_blocks(texts, size), "blocks")
    several = blocks.filter("block > 0").select("doc_id").distinct()
    # a document of one block is searched as it is: its values meet it without seeds
    alone = needles.join(blocks.join(several, "doc_id", "left_anti"), "doc_id")
    long = blocks.join(several, "doc_id", "left_semi")
    tried = _value_seeds(needles.join(several, "doc_id", "left_semi")).join(_text_seeds(long), ["doc_id", "seed"])
    met = tried.select("doc_id", "block", "needle").distinct().join(long, ["doc_id", "block"])
    found = alone.select(*met.columns).unionByName(met)
    return found.filter(_printed(F.col("needle"), F.concat("before", "text", "after"))).select("doc_id", "needle").distinct()


def ground(values: DataFrame, features: DataFrame) -> DataFrame:
    """values(doc_id, value[, page_no]) -> distinct (doc_id, value, verdict yes/no/unverifiable).

    A value is first looked for on the page it was read from (an equi-join that settles almost
    all); the rest is searched in the whole document.
    """
    tokens = F.regexp_replace(F.upper("layer"), "[^A-Z0-9]+", BREAK)
    trimmed = F.btrim(tokens, F.lit(BREAK))
    framed = F.when(trimmed == "", F.lit(BREAK)).otherwise(F.concat(F.lit(BREAK), trimmed, F.lit(BREAK)))
    kept = settle(features.filter("kept").select("doc_id", "page_no", F.when(F.col("layer") != "", framed).alias("stream")), "streams")
    stream = kept.filter(F.length("stream") > 1)
    complete = kept.groupBy("doc_id").agg(F.bool_and(F.col("stream").isNotNull()).alias("complete"))
    v = values.withColumn("needle", key_text(F.col("value")))
    own = (
        v.filter("page_no is not null and needle <> ''")
        .join(stream, ["doc_id", "page_no"])
        .filter(_printed(F.col("needle"), F.col("stream")))
        .select("doc_id", "needle")
        .distinct()
    )
    distinct = settle(v.select("doc_id", "value", "needle").distinct(), "values")
    own = settle(own, "own-page")
    rest = settle(distinct.join(own, ["doc_id", "needle"], "left_anti").filter("needle <> ''").select("doc_id", "needle").distinct(), "ungrounded")
    hit = own.unionByName(search(rest, stream)).withColumn("hit", F.lit(True))
    return (
        distinct.join(hit, ["doc_id", "needle"], "left")
        .join(complete, "doc_id", "left")
        .select(
            "doc_id", "value",
            F.when(F.col("hit"), "yes")
            .when(F.col("complete") & (F.col("needle") != ""), "no")
            .otherwise("unverifiable")
            .alias("verdict"),
        )
    )


# --- where lines and fields are printed ------------------------------------------------------
def lines_per_page(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Each line on the first page, not before the previous line's page, that prints both its
    taxable value and its line total; lines without such a page are left out.

    The candidate pages come from equi-joins with every figure that starts anywhere on a page, so a
    value inside a longer figure counts.
    """
    figures = pages.select(
        "doc_id", "page_no",
        F.explode(F.array_distinct(_all(F.col("text"), r"(?=(-?[0-9][0-9,]*\.[0-9]{2}))", 1))).alias("figure"),
    )
    want = lines.select(
        "doc_id", "line_no",
        printing.money(F.col("taxable_value")).alias("a"),
        printing.money(F.col("line_total")).alias("b"),
    )
    fa = figures.withColumnRenamed("figure", "a")
    fb = figures.withColumnRenamed("figure", "b")
    candidate = want.join(fa, ["doc_id", "a"]).join(fb, ["doc_id", "page_no", "b"])
    per_line = candidate.groupBy("doc_id", "line_no").agg(
        F.array_sort(F.collect_set("page_no")).alias("pages")
    )
    return in_order(per_line)


def _step(pages: Column, page: Column) -> Column:
    """The first of `pages` at or after `page`, else `page`."""
    return F.coalesce(F.array_min(F.filter(pages, lambda p: p >= page)), page)


def _jump(steps: Column, page: Column) -> Column:
    """A composed step function at `page`: its value at the first of its places at or after it."""
    return F.coalesce(F.get(F.filter(steps, lambda s: s["at"] >= page), F.lit(0))["to"], page)


def _composed(parts: Column, places: Column, one) -> Column:
    """One step function for several in a row, at the places where any of them has one. Between two places
    it is the value at the later one, as no step ends there; past the last it changes nothing."""
    through = lambda page: F.aggregate(parts, page, lambda now, part: one(part, now))
    return F.transform(F.array_sort(F.array_distinct(places)), lambda p: F.struct(p.alias("at"), through(p).alias("to")))


def _entries(parts: Column, start: Column, one) -> Column:
    """The page at which each of several steps in a row begins, and the last one ends."""
    return F.aggregate(parts, F.array(start), lambda pages, part: F.array_append(pages, one(part, F.element_at(pages, -1))))


def in_order(per_line: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_no): the first candidate page at or after the page of the line before.

    A scan of composed step functions: a line maps the page before it to its own; LINES lines compose to one
    function, LINES such blocks to one more, and only those meet per document. On the way back each level
    hands the pages at which its parts begin to them, so no document's lines are in one row or task.
    """
    lines = per_line.withColumn("block", F.floor(F.col("line_no") / LINES)).withColumn("group", F.floor(F.col("block") / LINES))
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    blocks = lines.groupBy("doc_id", "group", "block").agg(listed("line_no", "pages").alias("lines"))
    line = lambda part, page: _step(part["pages"], page)
    jump = lambda part, page: _jump(part["steps"], page)
    places = F.flatten(F.transform("lines", lambda x: x["pages"]))
    blocks = settle(blocks.withColumn("steps", _composed(F.col("lines"), places, line)), "line-blocks")
    groups = blocks.groupBy("doc_id", "group").agg(listed("block", "steps").alias("blocks"))
    places = F.flatten(F.transform("blocks", lambda b: F.transform(b["steps"], lambda s: s["at"])))
    groups = settle(groups.withColumn("steps", _composed(F.col("blocks"), places, jump)), "line-groups")

    zero = F.lit(0).cast(per_line.schema["pages"].dataType.elementType)
    docs = groups.groupBy("doc_id").agg(listed("group", "steps").alias("groups"))
    begins = docs.select("doc_id", F.inline(F.arrays_zip(F.transform("groups", lambda g: g["group"]).alias("group"), _entries(F.col("groups"), zero, jump).alias("page")))).filter("`group` is not null")
    met = groups.join(begins, ["doc_id", "group"])
    begins = met.select("doc_id", "group", F.inline(F.arrays_zip(F.transform("blocks", lambda b: b["block"]).alias("block"), _entries(F.col("blocks"), F.col("page"), jump).alias("page")))).filter("block is not null")
    met = blocks.join(begins, ["doc_id", "group", "block"])
    ends = F.slice(_entries(F.col("lines"), F.col("page"), line), F.lit(2), F.size("lines"))
    placed = met.select("doc_id", F.inline(F.arrays_zip("lines", ends.alias("page_no"))))
    # a line whose candidates all stand before the page it begins at keeps that page and is left out
    return placed.filter(F.array_contains(F.col("lines.pages"), F.col("page_no"))).select("doc_id", "lines.line_no", "page_no")
