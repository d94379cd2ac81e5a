"""GST identifiers, place of supply and state names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poledger.functions.constants import one_of, text_map
from poledger.refdata import ALPHANUMERIC, GSTIN_STATE_CODES, PAN_HOLDER_TYPES, STATES

GSTIN_SHAPE = r"\A[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z"
# The digits in the order of what they count for at even places: 2v, or 2v - 35 once v reaches 18.
DOUBLED = "".join(sorted(ALPHANUMERIC, key=lambda c: sum(divmod(2 * ALPHANUMERIC.index(c), 36))))
PAN_SHAPE = rf"\A[A-Z]{{3}}[{PAN_HOLDER_TYPES}][A-Z][0-9]{{4}}[A-Z]\z"


def gstin_check_char(gstin: Column) -> Column:
    """Check character of the first 14 characters (mod 36; even places count double, the two
    base-36 digits of the product added, which for 2v is 2v - 35 once v reaches 18). The characters are valid."""
    digits = (F.lit(DOUBLED), F.lit(ALPHANUMERIC))
    total = F.lit(-14)
    for place in range(1, 15):
        total = total + F.instr(digits[place % 2], F.substring(gstin, place, 1))
    return F.substr(F.lit(ALPHANUMERIC), (36 - total % 36) % 36 + 1, F.lit(1))


def is_valid_gstin(gstin: Column) -> Column:
    """Format, state code and check character; false for null."""
    ok = (
        gstin.rlike(GSTIN_SHAPE)
        & one_of(F.substring(gstin, 1, 2), GSTIN_STATE_CODES)
        & (F.substring(gstin, 15, 1) == gstin_check_char(gstin))
    )
    return F.coalesce(ok, F.lit(False))


def is_valid_pan(pan: Column) -> Column:
    return F.coalesce(pan.rlike(PAN_SHAPE), F.lit(False))


def pan_of(gstin: Column) -> Column:
    return F.substring(gstin, 3, 10)


def state_of_name(name: Column) -> Column:
    """Code of a state name (any case), null if unknown. Native map look-up, no join."""
    return F.try_element_at(text_map({n.lower(): code for code, n in STATES.items()}), F.lower(name))


def name_of_state(code: Column) -> Column:
    return F.try_element_at(text_map(STATES), code)


def is_state_code(code: Column) -> Column:
    return F.coalesce(one_of(code, STATES), F.lit(False))


def state_of_place(place: Column) -> Column:
    """'27-Maharashtra', 'Maharashtra (27)' or 'Maharashtra' -> '27'.

    The first stand-alone two-digit group that is a known code wins; otherwise the text
    without digits, brackets and dashes is read as a name.
    """
    groups = F.regexp_extract_all(place, F.lit(r"(?U)\b(\d{2})\b"), F.lit(1))
    by_code = F.try_element_at(F.filter(groups, lambda c: one_of(c, STATES)), F.lit(1))
    name = F.regexp_replace(F.regexp_replace(place, r"(?U)[\d()\-]", " "), r"(?U)\s+", " ")
    return F.coalesce(by_code, state_of_name(F.trim(name)))


def state_of_address(address: Column) -> Column:
    """Code of the state an address ends with (text after the last comma)."""
    return state_of_name(F.trim(F.regexp_extract(address, r"(?s)([^,]*)\z", 1)))
