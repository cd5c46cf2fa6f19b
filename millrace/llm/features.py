"""Hashed word n-grams and document statistics of many texts at once, for the learned operators.

Tokens are lower-cased (A-Z) runs of letters, digits, marks of other scripts and apostrophes; ASCII punctuation and white space separate them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.vec import BASE, LOWER, PLACES, WHITE, mix, word_hashes, word_spans

#: Every ASCII byte that is no letter or digit becomes a space, so words come without punctuation; other bytes stay.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256)], np.uint8)
#: The same, lower-cased.
TOKENS = LOWER[_PLAIN]


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the key's text leaves the remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most about `most` labelled rows to learn from, chosen by a hash of the key: (key, text, y).

    Held-out keys, null labels and keys with labels that differ are left out; of rows with one key, that with the smallest text is used.
    """
    own = labels.where(~held_out(F.col(key), modulus, remainder) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").select(key, F.col("y").cast("double").alias("y"))
    n = own.count()
    share = min(1.0, most / max(1, n))
    chosen = own.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 40)) < int(share * (1 << 40)))
    picked = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    return picked.join(F.broadcast(chosen), key).groupBy(key).agg(F.min(text).alias(text), F.min("y").alias("y"))  # at most about `most` keys, so the broadcast is bounded


def ngrams(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below 2**bits of each text (words, pairs of neighbours, and pairs with one or two words between), and their bounds.

    Features of a text are distinct and sorted.
    """
    data = TOKENS[data]
    starts, ends, bounds = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    n = len(h)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    keys, rows = [mix(h + np.uint64(11))], [row]
    for gap in (1, 2, 3):
        if n > gap:
            same = row[:-gap] == row[gap:]
            keys.append(mix(h[:-gap] * PLACES[gap] ^ h[gap:] * PLACES[gap + 8])[same])
            rows.append(row[:-gap][same])
    packed = (np.concatenate(rows).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(keys) >> np.uint64(64 - bits))
    packed = np.unique(packed)
    where = np.searchsorted(packed, np.arange(len(off), dtype=np.uint64) << np.uint64(bits))
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64), where


STATISTICS = 18


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text: sizes, ratios of character classes, and how much of it repeats."""
    rows = len(off) - 1
    out = np.zeros((rows, STATISTICS))
    if not len(data):
        return out
    size = np.diff(off)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)

    starts, ends, bounds = word_spans(data, off)
    words = np.diff(bounds)
    some = np.maximum(words, 1)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    ascii_mark = ~(upper | lower | digit | high | WHITE[data])
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    plain = (data == 46) | (data == 44)
    line_end = data == 10
    lengths = ends - starts
    sums = np.concatenate([[0], np.cumsum(lengths)])
    squares = np.concatenate([[0], np.cumsum(lengths.astype(np.float64) ** 2)])
    mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / some
    h = word_hashes(LOWER[data], starts, ends)
    row = np.repeat(np.arange(rows), words)
    packed = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((packed >> np.uint64(40)).astype(np.int64), minlength=rows)
    pairs = np.zeros(rows)
    many = np.zeros(rows)
    if len(h) > 1:
        same = row[1:] == row[:-1]
        p = mix(h[:-1] * BASE ^ h[1:])[same]
        q = np.unique((row[1:][same].astype(np.uint64) << np.uint64(40)) | (p >> np.uint64(24)))
        pairs = np.bincount((q >> np.uint64(40)).astype(np.int64), minlength=rows)
        many = np.bincount(row[1:][same & (h[1:] == h[:-1])], minlength=rows)
    ended = np.zeros(rows)
    marked = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    if len(ends):
        ended = np.bincount(row, weights=~((marked >= 128) | np.isin(marked, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,", np.uint8))), minlength=rows) / some
    capital = np.bincount(row, weights=upper[starts], minlength=rows) / some if len(starts) else np.zeros(rows)
    newlines = np.concatenate([[0], np.cumsum(line_end)])
    spread = np.sqrt(np.maximum((squares[bounds[1:]] - squares[bounds[:-1]]) / some - mean**2, 0))
    columns = [np.log1p(size), np.log1p(words), mean, spread, share(upper), share(lower), share(digit), share(high), share(ascii_mark), share(symbol), share(plain), share(WHITE[data]), distinct / some, pairs / np.maximum(words - 1, 1), many / some, ended, capital, np.log1p(newlines[off[1:]] - newlines[off[:-1]])]
    for k, c in enumerate(columns):
        out[:, k] = c
    return out
