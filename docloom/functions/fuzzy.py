"""String similarities that Spark has no built-in for, in Arrow batches."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import exact_form


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine word for each row of the table (Hyyroe's bits)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & places.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


@lru_cache(1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (m + n); two empty strings are alike."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


@lru_cache(1 << 14)
def best_window_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string against windows of the longer one, shorter ones at its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    used = set(short)
    best = 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        # Only windows that end, or at the tail begin, with a character of the shorter string can be best.
        if (window[-1] if end <= len(long) else window[0]) in used:
            best = max(best, 200.0 * common_subsequence(short, window) / (n + len(window)))
            if best == 100.0:
                break
    return best


def ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else best_window_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _title_score(heading: str, title: str) -> float:
    h, t = exact_form(heading), exact_form(title)
    return 100.0 if h and t and (h in t or t in h) else best_window_ratio(h, t)


@lru_cache(1 << 15)
def _title_score_of_short(heading: str, title: str) -> float:
    return _title_score(heading, title)


def title_score(heading: Column, title: Column) -> Column:
    """Partial ratio of two titles' normal forms, 100 where one holds the other.

    Pairs repeat from document to document; scores of short ones are kept (at most 1,000 characters each of 2^15 pairs).
    """

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = [None if p is None or q is None else (_title_score_of_short if len(p) + len(q) <= 1000 else _title_score)(p, q) for p, q in zip(x, y, strict=True)]
        return pd.Series(out, dtype="float64")

    return run(heading, title)


def _hits(needles: str | None, words: str | None, threshold: float) -> int:
    held = set(json.loads(words)) - {None} if words is not None else set()
    some = json.loads(needles) if needles is not None else ()
    return sum(t in held or any(200.0 * min(len(t), len(w)) >= threshold * (len(t) + len(w)) and indel_ratio(t, w) >= threshold for w in held) for t in some if t is not None)


@lru_cache(1 << 15)
def _hits_of_short(needles: str | None, words: str | None, threshold: float) -> int:
    return _hits(needles, words, threshold)


def fuzzy_hits(needles: Column, haystack: Column, threshold: float) -> Column:
    """How many needles are in the haystack or at least `threshold` alike to one of its words.

    Lengths bound the ratio from above by 200 * min / (m + n), so most words are never compared. Lists go to Python as
    texts, and what short ones gave is kept there (at most 1,000 characters each of 2^15 pairs).
    """

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = [(_hits_of_short if len(p or "") + len(q or "") <= 1000 else _hits)(p, q, threshold) for p, q in zip(x, y, strict=True)]
        return pd.Series(out, dtype="int32")

    return run(F.to_json(needles), F.to_json(haystack))
