"""String similarities Spark has no built-in for, as Arrow UDFs over candidate pairs only."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity 2M / T."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word operation per letter."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & where.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def token_set(left: frozenset, right: frozenset) -> float:
    """0..100: best of the shared words against each side, and of both sides with them."""
    if not left or not right:
        return 0.0
    both = left & right
    if both and (len(both) == len(left) or len(both) == len(right)):
        return 100.0
    shared = " ".join(sorted(both))
    full_a = f"{shared} {' '.join(sorted(left - both))}".strip()
    full_b = f"{shared} {' '.join(sorted(right - both))}".strip()
    best = indel(full_a, full_b)
    for full in (full_a, full_b) if both else ():
        # The shared words start the full text, so all of them are matched.
        best = max(best, 200.0 * len(shared) / (len(shared) + len(full)))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    words = {text: frozenset(text.split()) for text in {*a, *b}}
    return pd.Series([token_set(words[x], words[y]) for x, y in zip(a, b)], dtype="float64")


# Evaluated once per pair: never copied into a filter below its own projection.
sequence_ratio = sequence_ratio.asNondeterministic()
token_set_ratio = token_set_ratio.asNondeterministic()
