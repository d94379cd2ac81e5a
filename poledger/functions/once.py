"""Columns that many expressions read, computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns, each computed once for each row. A plain column is copied into every
    expression that reads it; a generator of one row keeps its values."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
