"""Page text features and identifier hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poledger.catalog import duck
from poledger.catalog.registry import query
from poledger.functions import printing
from poledger.operators import fieldless, pages
from poledger.refdata import HEADER_FIELDS, HEADER_KIND, MONTHS
from poledger.sources.bridge import indian

_MON = "|".join(m[:3] for m in MONTHS)
# Page features, written with RE2.
FEATURES = r"""
    SELECT doc_id, page_no, text, kind, CASE WHEN kind = 'native' AND page_no > 1
        AND regexp_matches(text, '(?im)^.{0,25}\bterms\s*(?:&|and)\s*conditions\b.{0,20}$')
        AND len(regexp_extract_all(text, '(?im)^\s*(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]\s+\S')) >= 3
        AND NOT regexp_matches(text, '\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b')
        AND NOT regexp_matches(text, '(?:₹|\bRs\.?|\bINR)\s*\d')
        AND NOT regexp_matches(text, '(?i)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[- ](?:__MON__)[a-z]*[-, ]+\d{2,4}\b')
        AND NOT regexp_matches(text, '(?im)^\s*(?:\d{1,2}[.)]\s*)?(?:payment|price basis|delivery|freight|mode of|despatch|dispatch|transport|place of delivery|packing|warranty|guarantee|validity)\b[^:\n]{0,30}:')
        AND len(regexp_extract_all(text, '\b\d{1,3}(?:,\d{2,3})*\.\d{2}\b')) < 2
        AND NOT (regexp_matches(text, '(?i)\b(?:qty|quantity)\b') AND regexp_matches(text, '(?i)\b(?:hsn|rate|uom|unit price)\b'))
        THEN 'terms' END AS skip
    FROM (SELECT doc_id, page_no, text,
                 CASE WHEN length(regexp_replace(text, '[^\pL\pN]', '', 'g')) > 50 THEN 'native' ELSE 'scanned' END AS kind
          FROM page_text) p""".replace("__MON__", _MON)
LAYERS = r"""
    SELECT doc_id, page_no, kind, skip IS NULL AS kept,
           CASE WHEN skip IS NULL AND kind = 'native' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS layer
    FROM features"""
V = {"features": FEATURES, "layers": LAYERS}


def features(t):
    return pages.page_features(t("page_text"))


@query("page_kind", "SELECT doc_id, page_no, kind FROM features", {"features": FEATURES})
def page_kind(t):
    return features(t).select("doc_id", "page_no", "kind")


@query("skipped_pages", "SELECT doc_id, page_no, kind FROM features WHERE skip IS NOT NULL", {"features": FEATURES})
def skipped_pages(t):
    return features(t).filter("skip_reason is not null").select("doc_id", "page_no", "kind")


@query(
    "page_content_flags",
    """SELECT doc_id, page_no, mode,
              mode <> 'image' AND skip IS NULL AND kind = 'native' AS carries_text,
              skip IS NULL AND (kind = 'scanned' OR mode <> 'text') AS needs_image
       FROM features, (VALUES ('text+image'), ('text'), ('image')) m(mode)""",
    {"features": FEATURES},
)
def page_content_flags(t):
    modes = [
        pages.page_features(t("page_text"), mode).select(
            "doc_id", "page_no", F.lit(mode).alias("mode"), F.col("layer").isNotNull().alias("carries_text"), "needs_image"
        )
        for mode in ("text+image", "text", "image")
    ]
    return reduce(DataFrame.unionByName, modes)


# --- hints. RE2 has no look-around, so the counterparts cut the text into runs first.
def _hint_sql(values: str) -> str:
    return f"""SELECT doc_id, value, min(page_no) AS first_page FROM ({values}) h GROUP BY doc_id, value"""


_TOKENS = "regexp_split_to_array(upper(layer), '[^A-Z0-9]+')"
_GSTIN_HITS = f"""SELECT doc_id, page_no, unnest(list_filter({_TOKENS}, lambda x:
    regexp_full_match(x, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]{{3}}'))) AS value FROM layers"""
_PAN_HITS = f"""SELECT doc_id, page_no, unnest(list_filter({_TOKENS}, lambda x: {duck.pan_ok("x")})) AS value FROM layers"""
_EMAIL_HITS = r"""SELECT doc_id, page_no, lower(unnest(regexp_extract_all(layer,
    '(?i)[A-Z0-9._%+-]+@[A-Z0-9-]+(?:\.[A-Z0-9-]+)*\.[A-Z]{2,}'))) AS value FROM layers"""
_DATE_RUNS = r"""SELECT doc_id, page_no, unnest(flatten(list_transform(
        regexp_extract_all(layer, '[0-9][0-9/.\-]*'), lambda r: regexp_split_to_array(r, '[/.\-]{2,}|[/.\-]$')))) AS raw
    FROM layers
    UNION ALL
    SELECT doc_id, page_no, unnest(regexp_extract_all(layer,
        '(?i)\b[0-9]{1,2}(?:st|nd|rd|th)?[ /.\-]*(?:__MON__)[a-z]*\.?,?[ /.\-]*[0-9]{4}\b|\b(?:__MON__)[a-z]*\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}\b')) AS raw
    FROM layers""".replace("__MON__", _MON)
_DATE_HITS = f"""SELECT doc_id, page_no, CAST({duck.parse_date("raw")} AS VARCHAR) AS value FROM ({_DATE_RUNS}) r
    WHERE {duck.parse_date("raw")} IS NOT NULL AND NOT regexp_full_match(raw, '[0-9]{{4}}-([0-9]-[0-9]{{1,2}}|[0-9]{{2}}-[0-9])')"""


@query(
    "hints_gstin",
    f"SELECT doc_id, value, first_page, {duck.gstin_ok('value')} AS valid FROM ({_hint_sql(_GSTIN_HITS)}) g",
    V,
)
def hints_gstin(t):
    return pages.hints(features(t), ("gstin",)).drop("kind")


@query("hints_pan", _hint_sql(_PAN_HITS), V)
def hints_pan(t):
    return pages.hints(features(t), ("pan",)).drop("kind", "valid")


@query("hints_email", _hint_sql(_EMAIL_HITS), V)
def hints_email(t):
    return pages.hints(features(t), ("email",)).drop("kind", "valid")


# Phones: each line's numbers with their context; a run is cut out whole, then tested.
_PHONE_HITS = r"""
    SELECT doc_id, page_no, CASE WHEN hit LIKE '+%' THEN '+' ELSE '' END || regexp_replace(hit, '\D', '', 'g') AS value
    FROM (
        SELECT doc_id, page_no, regexp_extract(raw, '(\+?[0-9][0-9 -]*[0-9])$', 1) AS hit, raw
        FROM (SELECT doc_id, page_no, unnest(regexp_extract_all(layer,
                '(?i)(?:\bphone: )\+91[ -]?[0-9]{5} [0-9]{5}')) AS raw FROM layers) r) h"""


@query("hints_phone")
def hints_phone(t):
    return pages.hints(features(t), ("phone",)).drop("kind", "valid")


@query("hints_date", _hint_sql(_DATE_HITS), V)
def hints_date(t):
    return pages.hints(features(t), ("date",)).drop("kind", "valid")


@query("hints_hsn")
def hints_hsn(t):
    return pages.hints(features(t), ("hsn",)).drop("kind", "valid")


@query("hints_all")
def hints_all(t):
    return pages.hints(features(t))


@query(
    "hint_counts",
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ({_hint_sql(h)}) g"
        for k, h in (("gstin", _GSTIN_HITS), ("pan", _PAN_HITS), ("email", _EMAIL_HITS), ("date", _DATE_HITS))
    ),
    V,
)
def hint_counts(t):
    h = pages.hints(features(t), ("gstin", "pan", "email", "date"))
    per_doc = h.groupBy("kind", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("kind").agg(F.sum("n").alias("hits"), F.count("*").alias("docs"))


# --- rows per page
# Every serial starts a chain; the next link is the nearest later n + 1.
_SERIALS = r"""
    SELECT doc_id, page_no, generate_subscripts(s, 1) AS pos, CAST(unnest(s) AS INT) AS n
    FROM (SELECT doc_id, page_no, regexp_extract_all(layer, '(?m)^[ \t]*([0-9]{1,3})(?:[ \t]|$)', 1) AS s
          FROM layers WHERE layer IS NOT NULL) x"""
_LINKS = """
    SELECT a.doc_id, a.page_no, a.pos, min(b.pos) AS nxt FROM serials a
    LEFT JOIN serials b ON b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.n = a.n + 1 AND b.pos > a.pos
    WHERE a.n > 0 GROUP BY a.doc_id, a.page_no, a.pos"""
_CHAINS = """
    SELECT doc_id, page_no, max(len) AS best FROM (
        WITH RECURSIVE walk(doc_id, page_no, pos, len) AS (
            SELECT doc_id, page_no, pos, 1 FROM links
            UNION ALL
            SELECT w.doc_id, w.page_no, l.nxt, w.len + 1
            FROM walk w JOIN links l ON l.doc_id = w.doc_id AND l.page_no = w.page_no AND l.pos = w.pos
            WHERE l.nxt IS NOT NULL)
        SELECT * FROM walk) c GROUP BY doc_id, page_no"""
_ROWS = """
    SELECT l.doc_id, l.page_no, CASE WHEN l.layer IS NOT NULL THEN coalesce(c.best, 0) END AS rows
    FROM layers l LEFT JOIN chains c ON c.doc_id = l.doc_id AND c.page_no = l.page_no WHERE l.kept"""
_ITEM_PAGES = """
    SELECT doc_id, page_no, rows FROM (
        SELECT *, max(rows) OVER (PARTITION BY doc_id) AS best FROM page_rows) x
    WHERE coalesce(best, 0) = 0 OR rows IS NULL OR rows > 0"""
ROW_VIEWS = {**V, "serials": _SERIALS, "links": _LINKS, "chains": _CHAINS, "page_rows": _ROWS,
             "item_pages": _ITEM_PAGES}


@query("estimate_rows", "SELECT doc_id, page_no, CAST(rows AS INT) AS rows FROM page_rows", ROW_VIEWS)
def estimate_rows(t):
    return pages.page_rows(features(t)).select("doc_id", "page_no", "rows")


@query("item_pages", "SELECT doc_id, page_no, CAST(rows AS INT) AS rows FROM item_pages", ROW_VIEWS)
def item_pages(t):
    return pages.item_pages(pages.page_rows(features(t)))


# --- grounding
_VALUES = (
    " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, CAST(NULL AS INT) AS line_no, {f} AS value FROM po_header WHERE {f} IS NOT NULL"
        for f in ("po_number", "buyer_gstin", "vendor_gstin", "bill_to_gstin", "ship_to_gstin", "buyer_pan", "vendor_pan")
    )
    + " UNION ALL SELECT doc_id, 'item_code', line_no, item_code FROM po_line"
    + " UNION ALL SELECT doc_id, 'hsn_sac', line_no, hsn_sac FROM po_line"
)
_CORPUS = r"""
    SELECT doc_id, bool_and(coalesce(layer <> '', false)) AS complete,
           '~' || coalesce(trim(string_agg(trim(regexp_replace(upper(layer), '[^A-Z0-9]+', '~', 'g'), '~'), '~' ORDER BY page_no)
                           FILTER (WHERE layer <> ''), '~'), '') || '~' AS corpus
    FROM layers WHERE kept GROUP BY doc_id"""
_VERDICTS = f"""
    SELECT DISTINCT v.doc_id, v.value,
        CASE WHEN needle <> '' AND length(needle) >= 8 AND contains(replace(corpus, '~', ''), needle) THEN 'yes'
             WHEN needle <> '' AND length(needle) < 8 AND regexp_matches(corpus,
                  '~' || regexp_replace(needle, '(.)', '\\1~?', 'g') || '~') THEN 'yes'
             WHEN needle <> '' AND length(needle) < 8 AND contains(corpus, '~' || needle || '~') THEN 'yes'
             WHEN complete AND needle <> '' THEN 'no' ELSE 'unverifiable' END AS verdict
    FROM (SELECT doc_id, value, {duck.key_text("value")} AS needle FROM ground_values) v
    JOIN corpus c ON c.doc_id = v.doc_id"""
GROUND_VIEWS = {**V, "ground_values": _VALUES, "corpus": _CORPUS, "verdicts": _VERDICTS}


@query("grounding", "SELECT doc_id, value, verdict FROM verdicts", GROUND_VIEWS)
def grounding(t):
    return pages.ground(pages.grounding_values(t("po_header"), t("po_line")), features(t))


# --- printed lines and values
def _mapped(t):
    return pages.lines_per_page(t("po_line"), t("page_text"))


_MAPPED = f"""
    SELECT l.doc_id, l.line_no, p.page_no
    FROM po_line l JOIN page_text p ON p.doc_id = l.doc_id
     AND contains(p.text, ' ' || ({indian("l.taxable_value")}) || ' ' || ({indian("l.line_total")}))"""


@query(
    "lines_per_page",
    "SELECT doc_id, line_no, CAST(min(page_no) AS INT) AS page_no FROM mapped GROUP BY doc_id, line_no",
    {"mapped": _MAPPED},
)
def lines_per_page(t):
    return _mapped(t)


_DMY = "lpad(CAST(day({0}) AS VARCHAR), 2, '0') || '/' || lpad(CAST(month({0}) AS VARCHAR), 2, '0') || '/' || CAST(year({0}) AS VARCHAR)"


def _printed(f: str) -> str:
    if HEADER_KIND[f] == "date":
        return _DMY.format(f)
    if HEADER_KIND[f] == "money":
        sign = f"CASE WHEN {f} < 0 THEN '-' ELSE '' END"
        return f"CASE WHEN {f} <> 0 THEN {sign} || ({indian(f'abs({f})')}) END"
    return f


_PRINTED = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {_printed(f)} AS printed FROM po_header"
    for f in HEADER_FIELDS
    if not f.endswith("_address")
)


@query("print_values", "SELECT doc_id, field, printed FROM printed WHERE length(printed) >= 4", {"printed": _PRINTED})
def print_values(t):
    return fieldless.printed_header_values(t("po_header"))


@query(
    "print_line_values",
    rf"""SELECT doc_id, line_no, {indian("taxable_value")} AS taxable,
               {indian("quantity", 3)} AS qty,
               regexp_replace(regexp_replace(CAST(gst_rate AS VARCHAR), '0+$', ''), '\.$', '') AS gst,
               CASE WHEN line_delivery_date IS NOT NULL THEN
                 CAST(day(line_delivery_date) AS VARCHAR) || CASE WHEN day(line_delivery_date) BETWEEN 11 AND 13 THEN 'th'
                   ELSE CASE day(line_delivery_date) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END
                 || ' ' || strftime(line_delivery_date, '%B') || ' ' || CAST(year(line_delivery_date) AS VARCHAR) END AS due
        FROM po_line""",
)
def print_line_values(t):
    return t("po_line").select(
        "doc_id", "line_no", printing.money(F.col("taxable_value")).alias("taxable"),
        printing.quantity(F.col("quantity")).alias("qty"),
        printing.percent(F.col("gst_rate")).alias("gst"),
        printing.date_in_style(F.col("line_delivery_date"), "long").alias("due"),
    )


_BODY = r"""
    SELECT p.doc_id, p.page_no, string_agg(line, chr(10) ORDER BY i) AS body
    FROM (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM page_text) p
    JOIN po_header h ON h.doc_id = p.doc_id
    WHERE trim(line) IS DISTINCT FROM buyer_name AND trim(line) <> 'Purchase Order ' || po_number
      AND NOT regexp_full_match(trim(line), 'Page \d+ of \d+')
    GROUP BY p.doc_id, p.page_no"""


@query(
    "fieldless_pages",
    """SELECT b.doc_id, b.page_no FROM body b
       WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.doc_id = b.doc_id AND m.page_no = b.page_no)
         AND NOT EXISTS (SELECT 1 FROM printed v WHERE v.doc_id = b.doc_id AND length(v.printed) >= 4
                         AND contains(b.body, v.printed))""",
    {"mapped": _MAPPED, "printed": _PRINTED, "body": _BODY},
)
def fieldless_pages(t):
    return fieldless.fieldless_pages(t("po_header"), t("page_text"), _mapped(t))
