"""Value cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog import duck
from poledger.catalog.registry import query
from poledger.functions import gst, words
from poledger.operators import clean
from poledger.refdata import FIELD_TYPE, GSTIN_STATE_CODES, HEADER_FIELDS

_GSTINS = " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS party, {p}_gstin AS value FROM po_header WHERE {p}_gstin IS NOT NULL"
    for p in ("buyer", "vendor", "bill_to", "ship_to")
)
_CHECKED = duck.gstin_ok("value")


@query(
    "audit_gstin",
    f"""SELECT doc_id, party, value, CASE
          WHEN NOT regexp_full_match(value, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]') THEN 'format'
          WHEN substr(value, 1, 2) NOT IN ({duck.quoted(GSTIN_STATE_CODES)}) THEN 'state code'
          WHEN NOT {_CHECKED} THEN 'check character' END AS problem
        FROM gstins""",
    {"gstins": _GSTINS},
)
def audit_gstin(t):
    return clean.audit_gstin(clean.party_values(t("po_header"), "gstin"))


@query(
    "audit_pan",
    f"""SELECT doc_id, party, pan AS value, {duck.pan_ok("pan")} AS valid,
               CASE WHEN {duck.gstin_ok("gstin")} THEN pan = substr(gstin, 3, 10) END AS matches
        FROM pans WHERE pan IS NOT NULL""",
    {
        "pans": """SELECT doc_id, 'buyer' AS party, buyer_pan AS pan, buyer_gstin AS gstin FROM po_header
                   UNION ALL SELECT doc_id, 'vendor', vendor_pan, vendor_gstin FROM po_header"""
    },
)
def audit_pan(t):
    h = t("po_header")
    return clean.audit_pan(clean.party_values(h, "pan"), clean.party_values(h, "gstin"))


@query(
    "parse_dates",
    f"""SELECT doc_id, printed, CAST(parsed AS VARCHAR) AS parsed FROM (
          SELECT doc_id, printed, {duck.parse_date("printed")} AS parsed FROM printed_date) x
        WHERE parsed IS NOT NULL""",
)
def parse_dates(t):
    ok, _ = clean.parse_dates(t("printed_date"), "printed")
    return ok.select("doc_id", "printed", F.col("parsed").cast("string").alias("parsed"))


@query(
    "parse_dates_refused",
    f"""SELECT doc_id, printed FROM printed_date WHERE {duck.parse_date("printed")} IS NULL""",
)
def parse_dates_refused(t):
    _, bad = clean.parse_dates(t("printed_date"), "printed")
    return bad.select("doc_id", "printed")


def _last_part(x: str) -> str:
    return duck.state_of_name(f"trim(regexp_extract({x}, '([^,]*)$', 1))")


@query(
    "place_to_state",
    f"""SELECT doc_id, {duck.state_of_place("place_of_supply")} AS place_state,
               {_last_part("buyer_address")} AS buyer_state, {_last_part("vendor_address")} AS vendor_state
        FROM po_header""",
)
def place_to_state(t):
    return clean.place_to_state(t("po_header"))


_NUMBERS = "map([" + duck.quoted(words.VALUES) + "], [" + ", ".join(map(str, words.VALUES.values())) + "])"
_SCALES = "map([" + duck.quoted(words.SCALE_WORDS) + "], [" + ", ".join(map(str, words.SCALE_WORDS.values())) + "])"


WORDS_SQL = f"""SELECT doc_id, CASE WHEN s.bad = 0 THEN CAST(s.c + s.g AS DOUBLE) END AS amount,
               CASE WHEN s.bad > 0 THEN 'not a number word' END AS problem
        FROM (SELECT doc_id, list_reduce(list_transform(list_filter(
                 string_split(trim(regexp_replace(lower(amount_in_words), '[^a-z]+', ' ', 'g')), ' '),
                 lambda w: w NOT IN ('rupees', 'rupee', 'rs', 'inr', 'indian', 'only', 'of', 'and')),
                 lambda w: {{'w': w, 'n': coalesce({_NUMBERS}[w], -1), 'm': coalesce({_SCALES}[w], -1),
                            'c': 0::BIGINT, 'g': 0::BIGINT, 'bad': 0}}),
               lambda a, b: {{'w': b.w, 'n': b.n, 'm': b.m,
                 'c': CASE WHEN b.w LIKE 'crore%' THEN (a.c + a.g) * b.m
                      WHEN b.m > 0 THEN a.c + greatest(a.g, 1) * b.m ELSE a.c END,
                 'g': CASE WHEN b.w = 'hundred' THEN greatest(a.g, 1) * 100
                      WHEN b.m > 0 THEN 0 WHEN b.n >= 0 THEN a.g + b.n ELSE a.g END,
                 'bad': a.bad + CASE WHEN b.n < 0 AND b.m < 0 AND b.w <> 'hundred' THEN 1 ELSE 0 END}},
               {{'w': '', 'n': 0, 'm': 0, 'c': 0::BIGINT, 'g': 0::BIGINT, 'bad': 0}}) AS s
              FROM po_header WHERE amount_in_words IS NOT NULL) x"""


@query("words_to_amount", WORDS_SQL)
def words_to_amount(t):
    return clean.words_to_amount(t("po_header")).withColumn("amount", F.col("amount").cast("double"))


_LONG = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, '{FIELD_TYPE[f]}' AS ftype, CAST({f} AS VARCHAR) AS value FROM pred_header"
    for f in HEADER_FIELDS
)


@query(
    "normalise",
    f"""SELECT doc_id, field, {duck.normal("ftype", "value")} AS norm
        FROM long WHERE value IS NOT NULL""",
    {"long": _LONG},
)
def normalise(t):
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.lit(FIELD_TYPE[f]).alias("ftype"), F.col(f).cast("string").alias("value")
        )
        for f in HEADER_FIELDS
    ]
    long = t("pred_header").select("doc_id", F.inline(F.array(*rows))).filter("value is not null")
    return clean.normalise_long(long).select("doc_id", "field", "norm")


@query(
    "gstin_state_share",
    f"""SELECT substr(value, 1, 2) AS state, count(*) AS parties,
               count(*) FILTER (WHERE {_CHECKED}) AS valid
        FROM gstins GROUP BY 1""",
    {"gstins": _GSTINS},
)
def gstin_state_share(t):
    v = clean.party_values(t("po_header"), "gstin")
    return v.groupBy(F.substring("value", 1, 2).alias("state")).agg(
        F.count("*").alias("parties"), F.count_if(gst.is_valid_gstin(F.col("value"))).alias("valid")
    )
