"""Jaro and Jaro-Winkler over whole Arrow batches, and lossless join keys for them."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Fixed values of the similarity: bonus per shared leading letter, at most four letters.
PREFIX_BONUS, PREFIX_LETTERS = 0.1, 4
_BATCH_CELLS = 2_000_000


def _codes(words: Sequence[str], width: int, ascii_only: bool) -> np.ndarray:
    """Character codes, one row per word, padded with 0; single bytes where possible."""
    if ascii_only:
        return np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _jaro_winkler_block(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    n1 = np.fromiter(map(len, left), dtype=np.int32, count=len(left))
    n2 = np.fromiter(map(len, right), dtype=np.int32, count=len(right))
    w1, w2 = max(int(n1.max()), 1), max(int(n2.max()), 1)
    ascii_only = "".join(left).isascii() and "".join(right).isascii()
    a, b = _codes(left, w1, ascii_only), _codes(right, w2, ascii_only)
    reach = np.maximum(1, np.maximum(n1, n2) // 2 - 1)[:, None]
    at = np.arange(w2, dtype=np.int32)[None, :]
    free = at < n2[:, None]
    hit1 = np.zeros(a.shape, dtype=bool)
    rows = np.arange(len(left))
    for i in range(w1):
        # Leftmost unused equal letter of the other word inside the window.
        open_ = (b == a[:, i : i + 1]) & free
        open_ &= np.abs(at - i) <= reach
        open_ &= (i < n1)[:, None]
        spot = open_.argmax(axis=1)
        found = open_[rows, spot]
        hit1[:, i] = found
        free[rows[found], spot[found]] = False
    hit2 = (at < n2[:, None]) & ~free
    count = hit1.sum(axis=1)
    wide = min(w1, w2)
    order1 = np.argsort(~hit1, axis=1, kind="stable")[:, :wide]
    order2 = np.argsort(~hit2, axis=1, kind="stable")[:, :wide]
    differs = np.take_along_axis(a, order1, 1) != np.take_along_axis(b, order2, 1)
    moved = (differs & (np.arange(wide)[None, :] < count[:, None])).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (count / n1 + count / n2 + (count - moved) / count) / 3.0
    jaro = np.where(count == 0, 0.0, jaro)
    lead = np.zeros(len(left), dtype=int)
    same = np.ones(len(left), dtype=bool)
    for i in range(min(PREFIX_LETTERS, w1, w2)):
        same &= (a[:, i] == b[:, i]) & (i < n1) & (i < n2)
        lead += same
    return jaro + lead * PREFIX_BONUS * (1 - jaro)


def jaro_winkler_pairs(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Scores of aligned pairs; pairs are blocked by length so memory stays bounded."""
    total = len(left)
    longest = np.maximum(
        np.fromiter(map(len, left), dtype=np.int32, count=total), np.fromiter(map(len, right), dtype=np.int32, count=total)
    )
    if total and total * int(longest.max()) <= _BATCH_CELLS:
        return _jaro_winkler_block(left, right)
    order = np.argsort(longest, kind="stable")
    scores = np.zeros(total)
    start = 0
    while start < total:
        step, stop = max(1, _BATCH_CELLS // max(1, int(longest[order[start]]))), start
        stop = min(total, start + step)
        while stop - start > 1 and (stop - start) * int(longest[order[stop - 1]]) > 2 * _BATCH_CELLS:
            stop = start + (stop - start) // 2
        picks = order[start:stop]
        scores[picks] = _jaro_winkler_block([left[i] for i in picks], [right[i] for i in picks])
        start = stop
    return scores


def jaro_winkler(left: Column, right: Column) -> Column:
    """Similarity in 0..1 as an Arrow-batched expression; NULL counts as empty."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(jaro_winkler_pairs(a.fill_null("").to_pylist(), b.fill_null("").to_pylist()))

    # Kept from being repeated inside pushed-down filters.
    return score.asNondeterministic()(left, right)


# --- keys that every pair above the threshold shares -------------------------------------
#
# With p equal leading letters (p = 0..4) a score of at least t needs
#   Jaro >= J_p = (t - 0.1 p) / (1 - 0.1 p),
# and Jaro >= J needs m / l1 + m / l2 >= 3 J - 1 matched letters m. So the two letter
# multisets share at least a = ceil((3 J_p - 1) * l1 * l2 / (l1 + l2)) letters, p of them in
# the prefix. Number repeated letters (e1, e2, ...), sort both letter sets in one fixed order,
# and two sets of sizes r1, r2 that share b letters have at least k of them in common among
# their first r1 - b + k and r2 - b + k letters. Every k-subset of those first letters is a
# key, together with p, the prefix and both lengths (lengths above 16 in bands of four, with
# the bound of the band's lowest lengths). Every word states its keys as the longer and as the
# shorter one of a pair, for each partner length the ratio m / l allows. Nothing at or above
# the threshold is lost; the score itself decides afterwards.

# Fixed order of letters, rare ones first, so that keys are selective; others sort before.
_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"
_RANK = {c: i + 1 for i, c in enumerate(_RARE_FIRST)}
_SLACK = 1e-9
_EXACT_LENGTHS, _BAND = 16, 4
# Subsets per word and partner length: more make keys more selective, fewer keep the shuffle small.
_MOST_KEYS = 10


def needed_share(prefix: int, threshold: float) -> float:
    """Least m / l1 + m / l2 of a pair with ``prefix`` equal leading letters."""
    least = (threshold - PREFIX_BONUS * prefix) / (1 - PREFIX_BONUS * prefix)
    if 3 * least <= 1:
        raise ValueError("threshold too low for lossless keys")
    return 3 * least - 1


def _band(length: int) -> tuple[int, int]:
    if length <= _EXACT_LENGTHS:
        return length, length
    low = length - (length - _EXACT_LENGTHS - 1) % _BAND
    return low, low + _BAND - 1


def _subset_size(bound: int, longer_missing: int, shorter_missing: int, most_keys: int) -> int:
    k = 1
    while k < bound and max(
        math.comb(longer_missing + k + 1, k + 1), math.comb(shorter_missing + k + 1, k + 1)
    ) <= most_keys:
        k += 1
    return k


@functools.lru_cache(maxsize=4096)
def _partners(length: int, prefix: int, threshold: float) -> list[tuple[str, str, int, int]]:
    """(role, key head, letters guaranteed, subset size) for every possible partner length."""
    x = needed_share(prefix, threshold)
    own = _band(length)
    lowest = max(1, prefix, math.ceil((x - 1) * length - _SLACK))
    highest = math.floor(length / (x - 1) + _SLACK)
    plans = []
    for other in sorted({_band(n) for n in range(lowest, highest + 1)}):
        for role, longer, shorter in (("longer", own, other), ("shorter", other, own)):
            if longer[0] < shorter[0]:
                continue
            low_l, low_s = longer[0], max(shorter[0], prefix)
            bound = math.ceil(x * low_l * low_s / (low_l + low_s) - _SLACK) - prefix
            size = 0
            if bound > 0:
                size = _subset_size(
                    bound, longer[1] - prefix - bound, shorter[1] - prefix - bound, _MOST_KEYS
                )
            plans.append((role, f"{longer[0]},{shorter[0]}|", max(bound, 0), size))
    return plans


def _letters(word: str) -> list[str]:
    seen: dict[str, int] = {}
    numbered = []
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        numbered.append((-seen[c], _RANK.get(c, 0), c))
    numbered.sort()
    return [f"{c}{-n}" for n, _, c in numbered]


def join_keys(word: str, threshold: float) -> dict[str, list[str]]:
    """Keys of a word as the longer and as the shorter one of a pair, each led by its p."""
    keys: dict[str, list[str]] = {"longer": [], "shorter": []}
    for p in range(min(PREFIX_LETTERS, len(word)) + 1 if word else 0):
        letters = _letters(word[p:])
        for role, head, bound, size in _partners(len(word), p, threshold):
            start = f"{p}|{word[:p]}|{head}"
            first = letters[: len(letters) - bound + size] if size else []
            keys[role] += [start + "".join(s) for s in itertools.combinations(first, size)]
    return keys


def letter_mask(word: str) -> int:
    """64 bits, one per numbered letter; letters beyond a-z and third copies share the last twelve."""
    mask = 0
    for numbered in _letters(word):
        letter, copy = numbered[0], int(numbered[1:])
        if "a" <= letter <= "z" and copy <= 2:
            place = (copy - 1) * 26 + ord(letter) - ord("a")
        else:
            place = 52 + (ord(letter) + copy) % 12
        mask |= 1 << place
    return mask - (1 << 64) if mask >> 63 else mask


def join_keys_column(word: Column, threshold: float) -> Column:
    """struct(longer array<string>, shorter array<string>, mask bigint) of a lower-case word."""

    @F.pandas_udf("struct<longer:array<string>,shorter:array<string>,mask:bigint>")
    def keys(words: pd.Series) -> pd.DataFrame:
        both = [join_keys(w or "", threshold) for w in words]
        return pd.DataFrame({
            "longer": [b["longer"] for b in both], "shorter": [b["shorter"] for b in both],
            "mask": [letter_mask(w or "") for w in words],
        })

    # Kept from being repeated inside pushed-down filters.
    return keys.asNondeterministic()(word)


def exactly_shared(a: Column, b: Column, prefix: Column) -> Column:
    """Whether ``prefix`` is all the two words share at the front, so a pair counts under one p only."""
    next_a, next_b = (F.substr(w, prefix + 1, F.lit(1)) for w in (a, b))
    return (prefix == PREFIX_LETTERS) | (next_a != next_b) | (next_a == "")


def possible_match(length_a: Column, length_b: Column, mask_a: Column, mask_b: Column,
                   prefix: Column, threshold: float) -> Column:
    """Bound that a pair with ``prefix`` equal leading letters meets; built-in expressions only.

    A mask bit that only one word has stands for at least one letter the other
    word lacks, which limits the letters the two can share.
    """
    only_a = F.bit_count(mask_a.bitwiseAND(F.bitwise_not(mask_b)))
    only_b = F.bit_count(mask_b.bitwiseAND(F.bitwise_not(mask_a)))
    shared = F.least(length_a - only_a, length_b - only_b)
    needed = F.lit(needed_share(PREFIX_LETTERS, threshold) - _SLACK)
    for p in range(PREFIX_LETTERS):
        needed = F.when(prefix == p, F.lit(needed_share(p, threshold) - _SLACK)).otherwise(needed)
    return shared * (length_a + length_b) >= needed * (length_a * length_b)
