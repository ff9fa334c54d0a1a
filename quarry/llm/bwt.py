"""Repeats of a minimum length by interval expansion on a Burrows-Wheeler transform.

The common-prefix array of a suffix array is derived from the transform alone: starting with the intervals of
single symbols, every interval of a word w is extended backwards to the intervals of all words cw, breadth
first, so prefixes come by increasing value; an interval whose right border is already known leads to no
new border and is dropped. The expansion stops at the minimum length: borders that are still unknown lie
between suffixes that agree in at least that many symbols. A frontier is a pair of numpy arrays.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0  # symbols are bytes + 1
_PACK = 7  # symbols of 9 bits in one 64-bit key


def suffix_order(sym: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(sym)
    padded = np.concatenate([sym.astype(np.uint64), np.zeros(_PACK, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(_PACK):
        key = (key << np.uint64(9)) | padded[j : j + n]
    h = _PACK
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(n, np.uint64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        if h >= depth or int(rank[order[-1]]) == n:
            return order
        after = np.zeros(n, np.uint64)
        after[: max(n - h, 0)] = rank[h:]
        key = (rank << np.uint64(32)) | after
        h *= 2


def _extend(bwt: np.ndarray, lf: np.ndarray, lb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of cw for every interval of w and every symbol c before it."""
    size = rb - lb
    total = int(size.sum())
    owner = np.repeat(np.arange(len(lb)), size)
    at = np.arange(total) - np.repeat(np.cumsum(size) - size - lb, size)
    real = bwt[at] != SEPARATOR
    at, owner = at[real], owner[real]
    to = lf[at]
    if len(to) == 0:
        return to, to
    order = np.argsort(to)
    to, owner, sym = to[order], owner[order], bwt[at[order]]
    cut = np.ones(len(to), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (sym[1:] != sym[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(to)) - 1
    return to[first], to[last] + 1


def long_prefix_classes(sym: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it a class: suffixes of one class agree in ``least`` symbols.

    Holds for suffixes with no separator among their first ``least`` symbols.
    """
    n = len(sym)
    order = suffix_order(sym, least + 1)
    bwt = np.where(order > 0, sym[order - 1], SEPARATOR)
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = True
    counts = np.bincount(sym, minlength=258)
    ends = np.cumsum(counts)
    used = np.flatnonzero(counts[1:]) + 1
    lb, rb = (ends - counts)[used], ends[used]
    known[rb] = True
    known[counts[SEPARATOR]] = True
    for _ in range(1, least):
        lb, rb = _extend(bwt, lf, lb, rb)
        fresh = ~known[rb]
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        known[rb] = True
    return order, np.cumsum(known[:n]) - 1


def repeated_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
    """True for each byte of the segments data[start:end] where a string of ``least`` bytes begins, inside
    its segment, that occurs twice or more; a segment of weight k counts k times. Segments lie end to end."""
    n_seg = len(starts)
    n = len(data) + n_seg
    shift = np.repeat(np.arange(n_seg), ends - starts)
    sym = np.zeros(n, np.uint16)
    place = np.arange(len(data)) + shift
    sym[place] = data.astype(np.uint16) + 1
    order, cls = long_prefix_classes(sym, least)
    room = np.repeat(ends, ends - starts) - np.arange(len(data))
    valid = np.zeros(n, bool)
    valid[place] = room >= least
    weight = np.zeros(n, np.int64)
    weight[place] = np.repeat(weights, ends - starts)
    ok = valid[order]
    total = np.bincount(cls[ok], weights=weight[order][ok], minlength=int(cls[-1]) + 1 if n else 0)
    out = np.zeros(n, bool)
    out[order[ok]] = total[cls[ok]] >= 2
    return out[place]
