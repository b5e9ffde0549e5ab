"""Similarity of token sets and strings."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """SO3: shared share of two arrays of distinct tokens, 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """SO3: shared share of the smaller array."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """SF17: Levenshtein distance of the first 64 characters, limit + 1 where it is larger than limit."""
    found = F.levenshtein(F.substring(a, 1, 64), F.substring(b, 1, 64), limit)
    return F.when(found < 0, limit + 1).otherwise(found)


@lru_cache(100_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SF12: share of characters in matching blocks; 0 where a text is empty or null. The order of arguments counts."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def best_ratios(tokens: pd.Series, targets: pd.Series) -> pd.Series:
    """For each token of an array the best sequence ratio with one of the targets, 0 without targets; null arrays are empty."""

    def one(own, others) -> list[float]:
        others = [] if others is None else list(others)
        return [1.0 if t in others else max((_ratio(t, o) for o in others), default=0.0) for t in ([] if own is None else own)]

    return pd.Series([one(a, b) for a, b in zip(tokens, targets, strict=True)], dtype=object)


def _covered(query: list[str], target: list[str]) -> float:
    """Mean over the query's tokens of the best: 1 if equal, 0.92 if one begins the other (4 letters), else their ratio."""
    if not query or not target:
        return 0.0

    def best(q: str) -> float:
        if q in target:
            return 1.0
        near = [0.92 if t.startswith(q) or q.startswith(t) else _ratio(q, t) if len(t) >= 4 else 0.0 for t in target] if len(q) >= 4 else [0.0]
        return max(near)

    return sum(map(best, query)) / len(query)


@F.pandas_udf(T.DoubleType())
def token_coverage(query: pd.Series, target: pd.Series) -> pd.Series:
    """SF13 over two arrays of tokens."""
    return pd.Series([_covered(list(q) if q is not None else [], list(t) if t is not None else []) for q, t in zip(query, target, strict=True)], dtype=float)


def one_swap(a: Column, b: Column) -> Column:
    """SF18: whether exchanging two neighbours turns one string into the other."""
    n = F.length(a)
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), F.lit(True)).cast("int")
    swapped = F.concat(F.substr(a, F.lit(1), at - 1), F.substr(a, at + 1, F.lit(1)), F.substr(a, at, F.lit(1)), F.substr(a, at + 2, n))
    return (n == F.length(b)) & (at > 0) & (swapped == b)


def closeness(a: float, b: float, span: float) -> int:
    """Millionths of 1 - |a - b| / span, as F.round(.., 6) has them: halves of the shortest decimal go up; 0 from a gap of span on."""
    gap = abs(a - b)
    if not gap < span:
        return 0
    x = 1 - gap / span
    whole = math.floor(x * 1e6)
    rest = x * 1e6 - whole
    if abs(rest - 0.5) > 1e-6:
        return whole + (rest > 0.5)
    return int(Decimal(repr(x)).scaleb(6).to_integral_value(ROUND_HALF_UP))
