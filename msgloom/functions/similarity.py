"""Similarity of titles and places, by published definitions of ratio.

ratio(a, b) = 2 * LCS / (|a| + |b|), with the longest common subsequence found bit-parallel.
Equal and empty texts are settled in Spark; the Arrow-batched helper gets nulls for them.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Words as sets: what is common, alone and with what each side has besides, compared by ratio."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    mine, yours = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not mine or not yours):
        return 1.0
    gap = 1 if shared else 0
    sizes = [len(shared) + gap + len(part) for part in (mine, yours)]
    distance = len(mine) + len(yours) - 2 * common(mine, yours)
    best = 1 - distance / (sizes[0] + sizes[1])
    if shared:
        best = max(best, *(2 * len(shared) / (len(shared) + size) for size in sizes))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer, shorter windows at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    best = best_window(a, b, 0.0)
    return best_window(b, a, best) if len(a) == len(b) else best


def best_window(a: str, b: str, best: float) -> float:
    """The best ratio of ``a`` with a window of ``b``, or ``best`` if that is higher.

    What two texts have in common is at most the letters they share in any order. That
    count moves along with the window, so only windows that may win are compared.
    """
    n = len(a)
    need = Counter(a)
    spare: Counter[str] = Counter()
    shared = 0
    for k in range(1 - n, len(b)):
        if k + n - 1 < len(b):
            c = b[k + n - 1]
            shared += spare[c] < need[c]
            spare[c] += 1
        if k > 0:
            c = b[k - 1]
            spare[c] -= 1
            shared -= spare[c] < need[c]
        size = min(k + n, len(b)) - max(0, k)
        if 2 * shared > best * (n + size):
            best = max(best, ratio(a, b[max(0, k) : k + n]))
            if best == 1.0:
                break
    return best


def _scored(a: Column, b: Column, helper) -> Column:
    empty_a, empty_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
    same = (a == b) & a.rlike(r"\S")
    # Spark runs the helper on all rows, so it gets nulls where the score is settled
    open_ = ~(empty_a | empty_b | same)
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).when(same, 1.0).otherwise(helper(F.when(open_, a), F.when(open_, b)))


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def title_score(a: Column, b: Column) -> Column:
    """1 for two empty titles, 0 for one, else the token set ratio."""
    return _scored(a, b, _token_set)


def location_score(a: Column, b: Column) -> Column:
    """1 for two empty places, 0 for one, else the partial ratio."""
    return _scored(a, b, _partial)
