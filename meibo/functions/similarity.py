"""String similarities: Jaro, Jaro-Winkler, Ratcliff-Obershelp, character scores."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str, floor: bool = False) -> float:
    """Jaro similarity; with ``floor`` half transpositions are rounded down, else they count as halves."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and not free[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            free[j] = False
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right))
    half = moved // 2 if floor else moved / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, boost_above: float = 0.0, floor: bool = False) -> float:
    """Jaro-Winkler similarity: up to four equal first characters raise the score, at any score by default."""
    j = jaro(a, b, floor)
    if j <= boost_above:
        return j
    p = 0
    while p < min(len(a), len(b), 4) and a[p] == b[p]:
        p += 1
    return j + p * weight * (1 - j)


#: characters of a name that one machine word has a bit for
WORD = 64
#: entries of a table of character positions
POSITIONS = 4_000_000


def jaro_winkler_many(codes: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = 0.0, weight: float = 0.1, boost_above: float = 0.0, floor: bool = False) -> np.ndarray:
    """``jaro_winkler`` of the names ``a[i]`` and ``b[i]`` for all i at once, bit by bit the same; 0 for some that are below ``threshold``.

    ``codes`` has a row of ``WORD`` numbers from 1 on (0 behind the name's end) for each name, small ones for few
    characters.  The names of a pair differ and have 1 to ``WORD`` characters.
    """
    out = np.zeros(len(a))
    rows, of = np.unique(b, return_inverse=True)
    n_chars = int(codes.max(initial=0)) + 1
    if len(rows) > 1 and len(rows) * n_chars > POSITIONS:
        low = of < len(rows) // 2
        for part in (low, ~low):
            out[part] = jaro_winkler_many(codes, length, a[part], b[part], threshold, weight, boost_above, floor)
        return out
    one, none = np.uint64(1), np.uint64(0)
    # the places of each character in each b, as bits
    at = np.zeros((len(rows), n_chars), np.uint64)
    for i in range(WORD):
        at[np.arange(len(rows)), codes[rows, i]] |= one << np.uint64(i)
    at[:, 0] = 0
    flat, base = at.ravel(), of * n_chars
    la, lb = length[a], length[b]
    most = int(la.max(initial=0))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    window = (one << (reach + 1).astype(np.uint64)) - one
    begin = codes[a, :4], codes[b, :4]
    chars = np.ascontiguousarray(codes[a, :most].T)
    taken, left = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for i in range(most):
        free = flat[base + chars[i]] & window & ~taken
        taken |= free & (~free + one)
        left |= (free != none).astype(np.uint64) << np.uint64(i)
        window = (window << one) | (reach > i)
    m = np.bitwise_count(taken).astype(np.int64)
    p, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for i in range(4):
        same &= (begin[0][:, i] == begin[1][:, i]) & (begin[0][:, i] > 0)
        p += same
    best = (m / la + m / lb + 1) / 3
    go = np.flatnonzero((m > 0) & (best + p * weight * (1 - best) >= threshold - 1e-9))
    m, la, lb, p, base, left, rest, chars = m[go], la[go], lb[go], p[go], base[go], left[go], taken[go], chars[:, go]
    moved = np.zeros(len(go), np.int64)
    for i in range(most):
        here = (left >> np.uint64(i)) & one
        first = rest & (~rest + one) * here
        moved += (first != none) & (flat[base + chars[i]] & first == none)
        rest = rest ^ first
    half = moved // 2 if floor else moved / 2
    j = (m / la + m / lb + (m - half) / m) / 3
    out[go] = np.where(j <= boost_above, j, j + p * weight * (1 - j))
    return out


def least_jaro(threshold: float, weight: float = 0.1) -> float:
    """The smallest Jaro similarity that four equal first characters can raise to ``threshold``."""
    return (threshold - 4 * weight) / (1 - 4 * weight)


def jaro_winkler_bound(shorter: Column, longer: Column, weight: float = 0.1) -> Column:
    """The highest Jaro-Winkler similarity that two lengths allow."""
    most = (2.0 + shorter / longer) / 3.0
    return most + F.least(F.lit(4), shorter) * weight * (1.0 - most)


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity with the standard junk heuristic for long strings."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _pairwise(name: str, score) -> Column:  # noqa: ANN001
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return udf


def jaro_winkler_col(a: Column | str, b: Column | str, floor: bool = False, boost_above: float = 0.0) -> Column:
    """Jaro-Winkler similarity of two columns, in Arrow batches; null with a null."""
    return _pairwise("jw", lambda x, y: jaro_winkler(x, y, floor=floor, boost_above=boost_above))(a, b)


def ratio_col(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp similarity of two columns, in Arrow batches."""
    return _pairwise("ratio", ratio)(a, b)


def character_scores(read: str, gold: str) -> tuple[float, float, float]:
    """(precision, recall, F1) of the characters in matching blocks."""
    hits = sum(m.size for m in difflib.SequenceMatcher(None, read, gold, autojunk=False).get_matching_blocks())
    p, r = hits / len(read) if read else 0.0, hits / len(gold) if gold else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def error_rate(read: Column | str, gold: Column | str) -> Column:
    """Character error rate: edits over the gold text's length."""
    return F.try_divide(F.levenshtein(read, gold), F.length(gold))


def is_variant(a: Column, b: Column) -> Column:
    """True if one name begins with the other, or both are as long and alike but for the last character."""
    last = (F.length(a) == F.length(b)) & (F.length(a) >= 2) & (F.substring(a, F.lit(1), F.length(a) - 1) == F.substring(b, F.lit(1), F.length(b) - 1))
    return a.startswith(b) | b.startswith(a) | last


def either_contains(a: Column, b: Column) -> Column:
    """True if one text contains the other."""
    return F.contains(a, b) | F.contains(b, a)
