"""Words, hashes and shingles of many texts at once, in NumPy over Arrow buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Since these six are ASCII, bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of BASE modulo 2**64."""
    return _powers(1 << max(10, int(n - 1).bit_length()))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slabs(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut to about `limit` bytes of text (at least one row each), so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text where its words begin (one more entry than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on its bytes only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=at[1:])
    within = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(at, sizes)
    values = BYTE_VALUES[data[np.repeat(starts, sizes) + within]]
    values *= powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(values, at) + sizes.astype(np.uint64) * BASE)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, and where each text's begin.

    A text with fewer words (but one) has one shingle, all of its words.
    """
    counts = np.diff(bounds)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=out[1:])
    first = np.arange(int(out[-1]), dtype=np.int64) - np.repeat(out[:-1] - bounds[:-1], number)
    total = np.zeros(len(first), np.uint64)
    last = np.repeat(bounds[1:], number)
    for k in range(size):
        here = first + k
        there = here < last
        total[there] += (words[here[there]] ^ PLACES[k + 32]) * PLACES[k]
    return mix(total), out
