"""Groups of equal windows in a text, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Suffixes are sorted as far as the threshold needs by prefix doubling, whose first step also gives the intervals of short strings. From these on, the
expansion extends every interval backward by the bytes that precede its suffixes; a right boundary found while strings of length k are extended has a common prefix of
exactly k with the suffix before it. Levels run breadth first, so values come in increasing order, and the work stops at the threshold: boundaries
not found by then have longer common prefixes, which is all that is asked.
"""

from __future__ import annotations

import numpy as np


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of all suffixes in order of their first `depth` values at least (0 stands behind the end).

    Also, for each place in the order, how many values its suffix shares with the one before, counted as far as the first sort went, and how far
    that was.
    """
    n = len(text)
    bits = max(1, int(n - 1).bit_length())
    first = max(1, min(depth, (64 - bits) // 8))
    padded = np.concatenate([text, np.zeros(first, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for k in range(first):
        keys = (keys << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    packed = np.sort((keys << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    mask = np.uint64((1 << bits) - 1)
    order = (packed & mask).astype(np.int64)
    values = packed >> np.uint64(bits)
    differ = np.zeros(n, np.uint64)
    differ[1:] = values[1:] ^ values[:-1]
    rank = _ranks(order, np.concatenate([[True], differ[1:] > 0]))
    shared = np.full(n, first, np.int8)
    for k in range(1, first + 1):
        shared[differ >= np.uint64(1) << np.uint64(8 * (first - k))] -= 1
    shared[0] = -1
    known = first
    while known < depth and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        if known < n:
            second[: n - known] = rank[known:] + 1
        width = int(rank[order[-1]] + 1).bit_length()
        if 2 * width + bits <= 64:
            packed = np.sort((rank.astype(np.uint64) << np.uint64(width + bits)) | (second.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
            order = (packed & mask).astype(np.int64)
        else:
            order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank = _ranks(order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        known *= 2
    return order, shared, first


def boundaries(text: np.ndarray, order: np.ndarray, shared: np.ndarray, first: int, least: int) -> np.ndarray:
    """For each place in `order`, whether its suffix and the one before share fewer than `least` values (0 in the text ends a string).

    The first levels, up to `first` values, are known from the sort; the expansion goes on from the intervals that end at their last level.
    """
    n = len(text)
    before = text[order - 1]  # of the first suffix, the last value, which is 0
    by_value = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    lf[by_value] = np.arange(n)
    cut = np.ones(n + 1, bool)
    cut[:n] = shared < first
    begins = np.flatnonzero(cut)
    last = np.concatenate([shared[begins[1:-1]] == first - 1, [False]])
    low, high = begins[:-1][last], begins[1:][last]
    bits = max(1, int(n).bit_length())
    for _ in range(first, least):
        if not len(low):
            break
        sizes = high - low
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        which = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(starts - low, sizes)
        value = before[at]
        real = value > 0  # a string never begins with the end of another
        which, at = which[real], at[real]
        if not len(at):
            break
        if bits + int(len(low)).bit_length() <= 63:
            packed = np.sort((which.astype(np.uint64) << np.uint64(bits)) | lf[at].astype(np.uint64))
            rows = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
            owner = packed >> np.uint64(bits)
        else:
            o = np.lexsort((lf[at], which))
            rows, owner = lf[at][o], which[o].astype(np.uint64)
        # rows of one value are one run of the transform's first column, so a run ends where the owner or the value changes
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[order[rows[1:]]] != text[order[rows[:-1]]])])
        begin = np.flatnonzero(new)
        i = rows[begin]
        j = i + np.diff(np.concatenate([begin, [len(rows)]]))
        fresh = ~cut[j]
        low, high = i[fresh], j[fresh]
        cut[high] = True
    return cut[:n]


def equal_windows(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts in order, and for each the number of its group; suffixes of a group share their first `least` values.

    Starts with fewer than `least` values before the next 0 are in groups of no meaning and must be left out by the caller.
    """
    order, shared, first = suffixes(text, least)
    return order, np.cumsum(boundaries(text, order, shared, first, least)) - 1
