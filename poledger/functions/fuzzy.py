"""Token-set similarity of two texts (0..100), the one measure Spark has no built-in for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per character of `b`."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set(left: str, right: str) -> float:
    """Best of three indel ratios over the shared words and the sorted remainders."""
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    shared, only_a, only_b = a & b, a - b, b - a
    if shared and (not only_a or not only_b):
        return 100.0
    rest_a, rest_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    core = len(" ".join(shared))
    gap = 1 if core else 0
    full_a, full_b = core + gap + len(rest_a), core + gap + len(rest_b)
    distance = len(rest_a) + len(rest_b) - 2 * _common(rest_a, rest_b)
    best = 100 - 100 * distance / (full_a + full_b)
    if core:
        best = max(best, 100 - 100 * (gap + len(rest_a)) / (core + full_a),
                   100 - 100 * (gap + len(rest_b)) / (core + full_b))
    return float(best)


@F.pandas_udf(DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = pd.Series(list(zip(left, right)))
    scores = {p: token_set(*p) for p in set(pairs) if None not in p}
    return pairs.map(scores)
