"""Which pairs of cookie values are alike, compared in blocks of values.

The Ratcliff-Obershelp ratio counts the characters of a row of common substrings, which is a common subsequence; so it is at most 2 LCS / (sum of
lengths). The LCS of all pairs of two blocks is found by bit vectors, a step for each character of the longer values and
all pairs at once, and only what passes that bound meets the matcher. (The bound by common characters as a multiset says
little: two random hexadecimal values of 32 characters share two thirds of theirs, and their LCS is well below half.)
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """The lengths of the longest common subsequences of each of ``a`` with each of ``b``."""
    letters = {c: i for i, c in enumerate(sorted(set("".join(a)) | set("".join(b))))}
    words = max(1, -(-max(map(len, a), default=0) // 64))
    masks = np.zeros((words, len(a), len(letters) + 1), dtype=np.uint64)
    for i, x in enumerate(a):
        for k, c in enumerate(x):
            masks[k >> 6, i, letters[c]] |= np.uint64(1) << np.uint64(k & 63)
    longest = max(map(len, b), default=0)
    codes = np.full((len(b), longest), len(letters), dtype=np.int64)
    for i, y in enumerate(b):
        codes[i, : len(y)] = [letters[c] for c in y]
    rows = [np.full((len(a), len(b)), ~np.uint64(0)) for _ in range(words)]
    for k in range(longest):
        carry = np.zeros((len(a), len(b)), dtype=np.uint64)
        for w in range(words):
            mine = masks[w][:, codes[:, k]]
            used = rows[w] & mine
            total = rows[w] + used
            over = total < used
            total += carry
            over |= total < carry
            rows[w] = total | (rows[w] & ~mine)
            carry = over.astype(np.uint64)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for w, r in enumerate(rows):
        size = np.array([min(64, max(0, len(x) - 64 * w)) for x in a], dtype=np.uint64)
        full = np.where(size == 64, ~np.uint64(0), (np.uint64(1) << (size & np.uint64(63))) - np.uint64(1))
        out += np.bitwise_count(~r & full[:, None])
    return out


#: Pairs whose bit vectors are held at once.
PAIRS = 1 << 18


def may_be_alike(a: list[str], b: list[str], threshold: float) -> Iterator[tuple[int, int]]:
    """The pairs whose ratio may be above the threshold, by rows."""
    step = max(1, PAIRS // max(1, len(b)))
    m = np.array([len(y) for y in b])
    for i in range(0, len(a), step):
        part = a[i : i + step]
        bound = 2 * common_subsequences(part, b) > threshold * (np.array([len(x) for x in part])[:, None] + m) - 1e-9
        bound |= np.array([not x for x in part])[:, None] & (m == 0)  # two empty values are equal
        for x, y in zip(*np.nonzero(bound), strict=True):
            yield i + int(x), int(y)


def alike(a: str, b: str, threshold: float) -> bool:
    return SequenceMatcher(None, a, b).ratio() > threshold


def may_exceed(a: str, b: str, threshold: float) -> bool:
    """The matcher's own bounds by lengths and common characters."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > threshold and m.quick_ratio() > threshold


def lengths_differ(a: str, b: str, most: float = 0.25) -> bool:
    """Whether two lengths differ by more than the share of the longer; an empty value differs from all but an empty one."""
    longer = max(len(a), len(b))
    return longer > 0 and (min(len(a), len(b)) == 0 or abs(len(a) - len(b)) / longer > most)
