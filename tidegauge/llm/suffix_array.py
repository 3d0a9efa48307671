"""Suffix arrays by two-stage sorting, to a bounded depth, with numpy.

Stage one sorts only the suffixes that are smaller than their successors, eight bytes a round, and of these only
such as still tie. Stage two scans the buckets of first bytes from the smallest up: what stands before a suffix that
is already placed, and is larger than it, goes to the next free place of its own bucket. A bucket is scanned as a
whole, so the number of steps is that of bytes in use (and the length of runs of one byte), not that of suffixes.

Suffixes that agree in the first ``depth`` bytes may stand in any order beside each other.
"""

from __future__ import annotations

import numpy as np


def words(t: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as a number that orders like them; zeros follow the end."""
    w = np.concatenate([t, np.zeros(depth + 16, dtype=np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        w = (w[:-n] << np.uint64(8 * n)) | w[n:]
    return w


def smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is larger than the empty one."""
    up = np.zeros(len(t), dtype=np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    up[-1] = -1
    at = np.where(up != 0, np.arange(len(t)), len(t))
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0  # a run of one byte is decided behind its end


def sort_directly(w: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in the order of their first ``depth`` bytes."""
    out = starts[np.argsort(w[starts], kind="stable")]
    key = w[out]
    new = np.r_[True, key[1:] != key[:-1]]
    for d in range(8, depth, 8):
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # neither alone in its group
        if not len(tied):
            break
        group, key = np.cumsum(new)[tied], w[out[tied] + d]
        order = np.lexsort((key, group))
        out[tied], key = out[tied][order], key[order]
        new[tied] |= np.r_[True, key[1:] != key[:-1]]
    return out


def suffix_array(t: np.ndarray, wanted: np.ndarray, depth: int, w: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` places (a mask over the bytes ``t``) in the order of the first ``depth`` bytes from there on."""
    if not len(t):
        return np.zeros(0, dtype=np.int64)
    w = words(t, depth) if w is None else w
    small = smaller(t)
    at = np.arange(len(t))
    # a larger suffix is placed from its successor, so that is needed too, up to the next one that is sorted directly
    before = np.r_[-1, np.maximum.accumulate(np.where(small, at, -1))[:-1]]
    need = np.maximum.accumulate(np.where(wanted, at, -1)) > before
    placed = sort_directly(w, np.flatnonzero(need & small), depth)
    sizes = np.bincount(t[need], minlength=256)
    first = np.r_[0, np.cumsum(sizes)]
    direct = np.r_[0, np.cumsum(np.bincount(t[placed], minlength=256))]
    out, fill = np.empty(first[-1], dtype=np.int64), first[:-1].copy()
    induced = need & ~small

    def put(found: np.ndarray) -> None:
        found = found[found >= 0]
        found = found[induced[found]]
        if len(found):
            bucket = t[found]
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            n = np.bincount(bucket, minlength=256)
            out[np.repeat(fill - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
            np.add(fill, n, out=fill)

    put(np.array([len(t) - 1]))
    for c in np.flatnonzero(sizes):
        done = first[c]
        while done < fill[c]:  # runs of this byte come into the bucket while it is scanned
            done, seen = fill[c], out[done : fill[c]].copy()
            put(seen - 1)
        block = placed[direct[c] : direct[c + 1]]
        out[first[c + 1] - len(block) : first[c + 1]] = block
        put(block - 1)
    return out[wanted[out]]


def common_prefixes(w: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the order but the first: the bytes that it shares with the place before it, ``depth`` at most."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    for d in range(0, depth, 8):
        x = w[a[left] + d] ^ w[b[left] + d]
        same = x == 0
        if not same.all():
            y, zeros = x[~same], np.zeros(int((~same).sum()), dtype=np.int64)
            for n in (32, 16, 8):  # leading zero bytes of the difference
                empty = y >> np.uint64(64 - n) == 0
                zeros += np.where(empty, n // 8, 0)
                y = np.where(empty, y << np.uint64(n), y)
            out[left[~same]] = d + zeros
        left = left[same]
    out[left] = depth
    return np.minimum(out, depth)
