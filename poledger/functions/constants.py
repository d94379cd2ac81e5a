"""Arrays and maps of fixed texts. Each is one expression; a literal for each entry, as Python would send them,
costs more time on the driver than many a job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> Column:
    return F.expr(f"array({', '.join(map(_text, values))})")


def text_map(pairs: Mapping[str, str]) -> Column:
    return F.expr(f"map({', '.join(f'{_text(k)}, {_text(v)}' for k, v in pairs.items())})")


def number_map(pairs: Mapping[str, int], kind: str) -> Column:
    return F.expr(f"map({', '.join(f'{_text(k)}, CAST({v} AS {kind})' for k, v in pairs.items())})")


def one_of(value: Column, values: Iterable[str]) -> Column:
    """Whether `value` is one of many fixed texts; null for null."""
    return F.array_contains(texts(values), value)
