"""DuckDB expressions for the counterparts, written independently of the Spark expressions."""

from __future__ import annotations

from poledger.refdata import (
    ALPHANUMERIC,
    GSTIN_STATE_CODES,
    MONTHS,
    PAN_HOLDER_TYPES,
    STATES,
)


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def gstin_ok(x: str) -> str:
    v = f"(instr('{ALPHANUMERIC}', substr({x}, i, 1)) - 1) * (2 - i % 2)"
    total = f"list_sum(list_transform(range(1, 15), lambda i: ({v}) // 36 + ({v}) % 36))"
    return (
        f"coalesce(regexp_full_match({x}, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]') "
        f"AND substr({x}, 1, 2) IN ({quoted(GSTIN_STATE_CODES)}) "
        f"AND substr('{ALPHANUMERIC}', CAST((36 - {total} % 36) % 36 + 1 AS INT), 1) = substr({x}, 15, 1), false)"
    )


def pan_ok(x: str) -> str:
    return (
        f"coalesce(regexp_full_match({x}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') "
        f"AND contains('{PAN_HOLDER_TYPES}', substr({x}, 4, 1)), false)"
    )


def known_state(x: str) -> str:
    return f"coalesce({x} IN ({quoted(STATES)}), false)"


def state_of_name(x: str) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN '{n.lower()}' THEN '{c}'" for c, n in STATES.items()) + " END"


def state_of_place(x: str) -> str:
    codes = f"list_filter(regexp_extract_all({x}, '\\b(\\d{{2}})\\b', 1), lambda c: c IN ({quoted(STATES)}))"
    name = f"trim(regexp_replace(regexp_replace({x}, '[\\d()\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"coalesce(({codes})[1], {state_of_name(name)})"


def parse_date(x: str) -> str:
    t = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    month = "CASE {m} " + " ".join(
        f"WHEN '{m}' THEN '{i}' WHEN '{m[:3]}' THEN '{i}'" if m != "may" else f"WHEN 'may' THEN '{i}'"
        for i, m in enumerate(MONTHS, 1)
    ) + " WHEN 'sept' THEN '9' ELSE '0' END"
    shapes = [
        ("^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", 1, 2, 3, False),
        ("^(\\d{1,2})[/.\\-](\\d{1,2})[/.\\-](\\d{4}|\\d{2})$", 3, 2, 1, False),
        ("^(\\d{1,2})(?:st|nd|rd|th)?[ /.\\-]*([a-z]+)\\.?,?[ /.\\-]*(\\d{4}|\\d{2})$", 3, 2, 1, True),
        ("^([a-z]+)\\.? (\\d{1,2})(?:st|nd|rd|th)?,? (\\d{4})$", 3, 1, 2, True),
    ]
    out = "CASE"
    for pattern, y, m, d, named in shapes:
        ye, me, de = (f"regexp_extract({t}, '{pattern}', {g})" for g in (y, m, d))
        if named:
            me = month.replace("{m}", me)
        ye = f"CASE WHEN length({ye}) = 2 THEN '20' || {ye} ELSE {ye} END"
        date = f"try_cast(({ye}) || '-' || lpad({me}, 2, '0') || '-' || lpad({de}, 2, '0') AS DATE)"
        out += f" WHEN regexp_matches({t}, '{pattern}') THEN CASE WHEN ({ye}) <> '0000' THEN {date} END"
    return out + " END"


def norm_text(x: str) -> str:
    return f"rtrim(trim(regexp_replace(lower(replace({x}, 'ß', 'ss')), '\\s+', ' ', 'g')), ' .,;:')"


def normal(ftype: str, x: str) -> str:
    number = f"try_cast(regexp_replace({x}, '[,\\s₹%]|(?i:\\b(?:inr|rs)\\b\\.?)', '', 'g') AS DECIMAL(28,2))"
    digits = f"regexp_replace({x}, '\\D', '', 'g')"
    forms = {
        "identifier": f"upper(regexp_replace({x}, '\\s+', '', 'g'))",
        "number": f"coalesce(CAST({number} AS VARCHAR), {norm_text(x)})",
        "date": f"coalesce(CAST({parse_date(x)} AS VARCHAR), {norm_text(x)})",
        "email": f"lower(trim({x}))",
        "phone": f"CASE WHEN {digits} <> '' THEN right({digits}, 10) ELSE {norm_text(x)} END",
        "text": norm_text(x),
    }
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms.items())
    return f"CASE WHEN regexp_matches({x}, '\\S') THEN nullif(CASE {ftype} {cases} END, '') END"


def key_text(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
