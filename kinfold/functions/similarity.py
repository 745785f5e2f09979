"""Similarities of token sets, token lists, strings and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def set_ratios(a: Column, b: Column, prefix: str = "") -> dict[str, Column]:
    """Ratios of the distinct tokens of two lists; 0 where the denominator is."""
    n = F.size(F.array_intersect(a, b)).cast("double")
    na, nb = F.size(F.array_distinct(a)).cast("double"), F.size(F.array_distinct(b)).cast("double")
    return {
        f"{prefix}jac": _ratio(n, na + nb - n), f"{prefix}dice": _ratio(2 * n, na + nb), f"{prefix}ovr": _ratio(n, F.least(na, nb)),
        f"{prefix}cont": _ratio(n, F.greatest(na, nb)), f"{prefix}prec": _ratio(n, nb), f"{prefix}rec": _ratio(n, na),
    }


def subset_either_way(a: Column, b: Column) -> Column:
    """Whether all tokens of one list are in the other; false if either is empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def subsequence(a: Column, b: Column) -> Column:
    """Whether a stands in b in order, gaps allowed; an empty list always does."""
    return F.aggregate(b, F.lit(0), lambda i, x: F.when((i < F.size(a)) & (F.get(a, i) == x), i + 1).otherwise(i)) == F.size(a)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return _ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word (here: an integer of any length) at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = s & where.get(c, 0)
        s = (s + m | s - m) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def jaro_winkler(a: str, b: str) -> float:
    """Textbook definition: window max // 2 - 1, prefix of up to four at weight 0.1 above a Jaro value of 0.7; 0 if
    either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _distinct_pairs(a: pd.Series, b: pd.Series, f) -> pd.Series:
    """f once for each distinct pair of strings of a batch."""
    known: dict[tuple, float | None] = {}
    out = np.empty(len(a))
    for k, p in enumerate(zip(a, b)):
        if p not in known:
            known[p] = np.nan if p[0] is None or p[1] is None else f(*p)
        out[k] = known[p]
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct_pairs(a, b, indel)


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct_pairs(a, b, jaro_winkler)
