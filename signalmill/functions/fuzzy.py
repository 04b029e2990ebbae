"""A weighted similarity of names between 0 and 100.

Spark has no longest-common-subsequence function, so the score is a Pandas UDF
over the pairs that blocking leaves. Its building block is the share of two
strings that a longest common subsequence keeps, computed with one big integer
per character (bit-parallel), so a pair of usual names takes some microseconds.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# When the lengths differ enough for partial matches, and how much
# those and matches of reordered words count.
PARTIAL_FROM, FAR_FROM = 1.5, 8.0
TOKEN_SHARE, PARTIAL_SHARE, FAR_SHARE = 0.95, 0.9, 0.6


def common_subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        held = row & places.get(c, 0)
        row = (row + held | row - held) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in hundredths."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one; windows
    also hang over its ends."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    n, letters = len(short), set(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        edge = window[-1] if start + n <= len(long) else window[0]
        if edge in letters:  # a window whose free end matches nothing can't be the best one
            best = max(best, ratio(short, window))
    if len(a) == len(b):
        for start in range(1 - n, n):
            window = short[max(0, start) : start + n]
            best = max(best, ratio(long, window))
    return best


def _tokens(a: str, b: str) -> tuple[str, str, str, str, str]:
    """Sorted words of each, the words of both, and those of one alone."""
    x, y = a.split(), b.split()
    both = sorted(set(x) & set(y))
    return " ".join(sorted(x)), " ".join(sorted(y)), " ".join(both), " ".join(sorted(set(x) - set(both))), " ".join(sorted(set(y) - set(both)))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of sorted words and that of their sets."""
    sorted_a, sorted_b, both, only_a, only_b = _tokens(a, b)
    best = ratio(sorted_a, sorted_b)
    if both:
        if not only_a or not only_b:
            return 100.0
        with_a, with_b = f"{both} {only_a}", f"{both} {only_b}"
        best = max(best, ratio(with_a, with_b), ratio(both, with_a), ratio(both, with_b))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """100 if they share a word; else the partial ratio of sorted words, or of
    those that only one has."""
    sorted_a, sorted_b, both, only_a, only_b = _tokens(a, b)
    if both:
        return 100.0
    return max(partial_ratio(sorted_a, sorted_b), partial_ratio(only_a, only_b))


@lru_cache(maxsize=100_000)
def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain, token and partial ratios, each with its share."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < PARTIAL_FROM:
        return max(best, TOKEN_SHARE * token_ratio(a, b))
    share = PARTIAL_SHARE if apart <= FAR_FROM else FAR_SHARE
    return max(best, share * partial_ratio(a, b), TOKEN_SHARE * share * partial_token_ratio(a, b))


def similarity(a: Column, b: Column) -> Column:
    """:func:`weighted_ratio` of two columns; 0 where one is null."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(x, y) if x and y else 0.0 for x, y in zip(left, right, strict=True)], dtype=float)

    return score(a, b)


#: Characters of normalised names.
CHARACTERS = " abcdefghijklmnopqrstuvwxyz0123456789"


def letters(name: Column) -> Column:
    """How often each of CHARACTERS stands in a normalised name."""
    return F.transform(F.split(F.lit(",".join(CHARACTERS)), ","), lambda c: F.length(name) - F.length(F.replace(name, c, F.lit(""))))


def may_reach(a: Column, b: Column, letters_a: Column, letters_b: Column, least: float) -> Column:
    """Whether the similarity of two normalised names can reach ``least``, by
    Spark's own functions: names that share or repeat a word may, and others only
    with enough letters in common, as a common subsequence has no more than those
    and a window of the longer name that hangs over its end may be as short."""
    words = [F.split(x, " ") for x in (a, b)]
    shared = F.arrays_overlap(*words)
    for own in words:
        shared = shared | (F.size(F.array_distinct(own)) < F.size(own))
    common = F.aggregate(F.zip_with(letters_a, letters_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    whole = 200.0 * common / (short + long)
    part = F.when(long >= PARTIAL_FROM * short, PARTIAL_SHARE * 200.0 * common / (short + common)).otherwise(0.0)
    return shared | (F.greatest(whole, part) >= least)


def edit_similarity(a: Column, b: Column) -> Column:
    """Edits over the longer length, as a score from 0 to 100; Spark's own functions alone."""
    return F.round(100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))), 4)
