"""Fuzzy scores from 0 to 100 by the longest common subsequence, as Arrow UDFs.

ratio: 200 * lcs / (len a + len b). partial: the best ratio of the shorter text with a window of the longer.
token_set: words in common against what each side has besides. Callers filter by cheap keys first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _masks(a: str, b: str) -> list[int]:
    """For each character of b the bits of its places in a."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    return [places.get(c, 0) for c in b]


def _common(n: int, masks: list[int]) -> int:
    """Length of the longest common subsequence of n characters and those with these masks, a word of bits at a time."""
    full = (1 << n) - 1
    row = full
    for p in masks:  # bits that are carried past the n-th never come back
        u = row & p
        row = row + u | row - u
    return n - (row & full).bit_count()


def _lcs(a: str, b: str) -> int:
    return _common(len(a), _masks(a, b))


def ratio_of(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_of(a: str, b: str, least: float = 0.0) -> tuple[float, int, int]:
    """(best score, from, to) of the shorter against windows of the longer, ends of it too; zeros if below least.

    A window that moves on by d has at most d more in common, so windows that can't beat the best are skipped.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n:
        return (100.0 if not m else 0.0), 0, 0
    if (at := long.find(short)) >= 0:
        return 100.0, at, at + n
    masks = _masks(short, long)
    best, found = least - 1e-9 if least else 0.0, (0.0, 0, 0)
    end, common = 0, 0
    while True:
        # Up to the longer's end the windows that can't do are counted, beyond it they are tried.
        step = (best * (n + end) - 200.0 * common) / (200.0 - best)
        if end + step > n:
            step = max(n - end, best * n / 100.0 - common)
        step = max(1, int(min(step, m - end)) - 1)
        while (last := end + step) < m + n:
            size = min(last, m) - max(0, last - n)
            if 200.0 * min(common + step, size) > best * (n + size):
                break
            step += 1
        if last >= m + n:
            return found
        end, lo, hi = last, max(0, last - n), min(last, m)
        common = _common(n, masks[lo:hi])
        score = 200.0 * common / (n + hi - lo)
        if score > best:
            best, found = score, (score, lo, hi)


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (only_x and only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(ratio_of(left, right), *((ratio_of(both, left), ratio_of(both, right)) if both else (0.0,)))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def partial_ratio(a, b, least: float = 0.0):
    """The partial score, 0 if it is below least."""

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else partial_of(p, q, least)[0] for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
