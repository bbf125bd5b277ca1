"""Ratios of two texts by their longest common subsequence, alone and as a column by Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> int:
    """0 to 100: twice the common subsequence against both lengths."""
    total = len(a) + len(b)
    return round(100 * 2 * common_length(a, b) / total) if total else 100


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.lower().split()))


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(sorted_words(a), sorted_words(b))


def token_set_ratio(a: str, b: str) -> int:
    """The best of: shared words against each side's words, and the sides against each other."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = (both + " " + left).strip(), (both + " " + right).strip()
    if both and (not left or not right):
        return 100
    return max(ratio(one, two), ratio(both, one) if both else 0, ratio(both, two) if both else 0)


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter text against any stretch of the longer one as long as it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100 if not long else 0
    return max(ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


_RATIOS = {"token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "plain": ratio}


def fuzzy(a: Column, b: Column, kind: str = "token_sort") -> Column:
    """The ratio of two texts by Arrow batches; null if either is null."""
    score = _RATIOS[kind]

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(p) or pd.isna(q) else score(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)
