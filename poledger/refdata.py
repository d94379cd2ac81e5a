"""Reference data: GST states, purchase-order fields, wire keys, rule constants.

Everything here is a fixed value of the domain or of the wire format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: official GST state codes ------------------------------------------------
STATES: dict[str, str] = {
    "01": "Jammu and Kashmir",
    "02": "Himachal Pradesh",
    "03": "Punjab",
    "04": "Chandigarh",
    "05": "Uttarakhand",
    "06": "Haryana",
    "07": "Delhi",
    "08": "Rajasthan",
    "09": "Uttar Pradesh",
    "10": "Bihar",
    "11": "Sikkim",
    "12": "Arunachal Pradesh",
    "13": "Nagaland",
    "14": "Manipur",
    "15": "Mizoram",
    "16": "Tripura",
    "17": "Meghalaya",
    "18": "Assam",
    "19": "West Bengal",
    "20": "Jharkhand",
    "21": "Odisha",
    "22": "Chhattisgarh",
    "23": "Madhya Pradesh",
    "24": "Gujarat",
    "26": "Dadra and Nagar Haveli and Daman and Diu",
    "27": "Maharashtra",
    "29": "Karnataka",
    "30": "Goa",
    "31": "Lakshadweep",
    "32": "Kerala",
    "33": "Tamil Nadu",
    "34": "Puducherry",
    "35": "Andaman and Nicobar Islands",
    "36": "Telangana",
    "37": "Andhra Pradesh",
    "38": "Ladakh",
}
# Codes a GSTIN may also start with: retired states (25, 28) and special jurisdictions (97, 99).
GSTIN_ONLY_STATE_CODES = ("25", "28", "97", "99")
GSTIN_STATE_CODES = (*STATES, *GSTIN_ONLY_STATE_CODES)
# PAN holder types (4th letter).
PAN_HOLDER_TYPES = "ABCFGHJLPT"
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# --- Fixed values: month names accepted in printed dates -----------------------------------
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
MONTH_SPELLINGS = (*MONTHS, *(m[:3] for m in MONTHS), "sept")

# --- Fixed values: the purchase order's 58 header fields, their wire keys and kinds ---------
# full name, short key, storage kind (text / date / money), comparison type
_HEADER = """
po_number            po_no     text   identifier
po_date              po_dt     date   date
amendment_no         amd_no    text   identifier
amendment_date       amd_dt    date   date
quotation_ref        quot_ref  text   identifier
quotation_date       quot_dt   date   date
indent_no            ind_no    text   identifier
currency             curr      text   identifier
delivery_date        del_dt    date   date
po_validity_date     valid_dt  date   date
buyer_name           b_name    text   text
buyer_address        b_addr    text   text
buyer_gstin          b_gstin   text   identifier
buyer_pan            b_pan     text   identifier
buyer_state          b_state   text   text
buyer_state_code     b_stcd    text   identifier
buyer_contact_person b_cont    text   text
buyer_phone          b_phone   text   phone
buyer_email          b_email   text   email
vendor_name          v_name    text   text
vendor_code          v_code    text   identifier
vendor_address       v_addr    text   text
vendor_gstin         v_gstin   text   identifier
vendor_pan           v_pan     text   identifier
vendor_state         v_state   text   text
vendor_state_code    v_stcd    text   identifier
vendor_contact_person v_cont   text   text
vendor_phone         v_phone   text   phone
vendor_email         v_email   text   email
bill_to_name         bt_name   text   text
bill_to_address      bt_addr   text   text
bill_to_gstin        bt_gstin  text   identifier
bill_to_state_code   bt_stcd   text   identifier
ship_to_name         st_name   text   text
ship_to_address      st_addr   text   text
ship_to_gstin        st_gstin  text   identifier
ship_to_state_code   st_stcd   text   identifier
payment_terms        pay_term  text   text
delivery_terms       del_term  text   text
freight_terms        frt_term  text   text
mode_of_transport    transp    text   text
place_of_supply      pos       text   text
delivery_location    del_loc   text   text
warranty_terms       warranty  text   text
packing_instructions packing   text   text
subtotal             subtotal  money  number
discount_total       disc_tot  money  number
freight_charges      freight   money  number
other_charges        oth_chg   money  number
cgst_total           cgst_tot  money  number
sgst_total           sgst_tot  money  number
igst_total           igst_tot  money  number
total_tax            tax_tot   money  number
round_off            rnd_off   money  number
grand_total          gr_total  money  number
amount_in_words      in_words  text   text
prepared_by          prep_by   text   text
approved_by          appr_by   text   text
"""
_HEADER_ROWS = [line.split() for line in _HEADER.strip().splitlines()]
HEADER_FIELDS = [r[0] for r in _HEADER_ROWS]
# Wire keys; the item list has one too.
SHORT_TO_FULL = {r[1]: r[0] for r in _HEADER_ROWS} | {"items": "line_items"}
HEADER_KIND = {r[0]: r[2] for r in _HEADER_ROWS}

# --- Fixed values: the 15 line-item columns -------------------------------------------------
# name, SQL type, comparison type, in the compact answer row?
_LINE = """
line_no            int            number      row
item_code          string         identifier  row
description        string         text        row
hsn_sac            string         identifier  row
quantity           decimal(15,3)  number      row
uom                string         identifier  row
unit_rate          decimal(15,2)  number      row
discount_pct       decimal(5,2)   number      row
taxable_value      decimal(18,2)  number      row
gst_rate           decimal(5,2)   number      row
cgst_amount        decimal(18,2)  number      computed
sgst_amount        decimal(18,2)  number      computed
igst_amount        decimal(18,2)  number      computed
line_total         decimal(18,2)  number      row
line_delivery_date date           date        row
"""
_LINE_ROWS = [line.split() for line in _LINE.strip().splitlines()]
LINE_COLUMNS = [r[0] for r in _LINE_ROWS]
LINE_TYPE = {r[0]: r[1] for r in _LINE_ROWS}
ROW_COLUMNS = [r[0] for r in _LINE_ROWS if r[3] == "row"]

FIELD_TYPE = {r[0]: r[3] for r in _HEADER_ROWS} | {r[0]: r[2] for r in _LINE_ROWS}
COMPUTED_HEADER_FIELDS = ("total_tax",)
COMPUTED_LINE_COLUMNS = tuple(r[0] for r in _LINE_ROWS if r[3] == "computed")
CRITICAL_HEADER_FIELDS = (
    "po_number", "po_date", "buyer_name", "buyer_gstin", "vendor_name", "vendor_gstin",
    "subtotal", "cgst_total", "sgst_total", "igst_total", "grand_total",
)
CRITICAL_LINE_COLUMNS = (
    "line_no", "description", "hsn_sac", "quantity", "unit_rate", "taxable_value", "gst_rate",
    "line_total",
)

# --- Fixed values: rules, routing, scoring --------------------------------------------------
RULES = (
    "schema", "gstin", "tax_regime", "line_arithmetic", "totals", "continuity",
    "amount_in_words", "formats", "grounding", "masters", "duplicate_po",
)
# --- Fixed values: the texts of failed checks, with places for what was found -----------------
PROBLEM_TEXT = {
    "missing": "{}: missing",
    "no result": "{}: no result",
    "row": "{} {}: {}",
    "gstin": "{}_gstin {} fails the format/checksum",
    "state code": "{}_state_code {} does not match GSTIN {}",
    "state": "{}_state '{}' does not match GSTIN state {}",
    "pan": "{}_pan {} is not a valid PAN",
    "pan in gstin": "{}_pan {} != PAN in GSTIN {}",
    "no supply": "cannot tell intra- from inter-state: vendor state or place of supply unknown",
    "supply": "{}-state supply but {} is not 0",
    "subtotal": "sum of taxable values {} != subtotal {}",
    "tax total": "{} of the lines {} != {}_total {}",
    "grand total": "grand_total {} != components {}",
    "round off": "round_off {} exceeds 1.00",
    "words": "words say {}, grand_total is {}",
    "before": "{} {} is before po_date {}",
    "after": "quotation_date {} is after po_date",
    "currency": "unknown currency '{}'",
    "taxable": "line {}: taxable {} != qty x rate = {}",
    "line total": "line {}: line_total {} != {}",
    "hsn": "line {}: HSN/SAC '{}' is not 4-8 digits",
    "delivery": "line {}: delivery date {} before PO",
    "party": "{} {} is not in the party master",
    "item": "line {}: item code {} unknown",
    "processed": "PO {} was already processed for buyer {}",
    "not printed": "{} '{}' not in the text layer",
    "no lines": "no line items",
}
PARTIES = ("buyer", "vendor", "bill_to", "ship_to")
CURRENCIES = (
    "INR", "USD", "EUR", "GBP", "JPY", "CNY", "AED", "SGD", "CHF", "AUD", "CAD", "HKD", "SAR",
)
GROUNDED_HEADER_FIELDS = (
    "po_number", "buyer_gstin", "vendor_gstin", "bill_to_gstin", "ship_to_gstin",
    "buyer_pan", "vendor_pan",
)
DETAIL_ITEMS = 5  # problems spelled out in a check's detail text
GAP_ITEMS = 20  # missing line numbers spelled out in the continuity detail
NATIVE_MIN_CHARS = 50
ROW_LIMIT, PAGE_LIMIT = 40, 2  # adaptive routing thresholds
MAX_TOKENS = {"header": 2000, "lines": 6000}
RETRY_EXTRA_TOKENS, RETRY_DEADLINE_S = 4000, 40.0
FIRST_ALIAS, RETRY_ALIAS = "po-fast", "po-accurate"
OUTCOMES = ("correct", "wrong", "missed", "hallucinated", "correct_absent")
TARGETS = {"field_accuracy": 0.97, "critical_doc_accuracy": 0.98, "row_recall": 0.995}
JOB_STATUSES = ("queued", "processing", "completed", "needs_review", "failed")


def header_sql_type(field: str) -> str:
    return {"text": "string", "date": "date", "money": "decimal(18,2)"}[HEADER_KIND[field]]


def states_df(spark: SparkSession) -> DataFrame:
    """The 36 states as a table (bounded: safe to broadcast)."""
    return spark.createDataFrame(list(STATES.items()), "code string, name string")
