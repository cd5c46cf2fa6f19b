"""Best-fit packing of tokenised documents into sequences, after a dominance reduction.

Only the number of pieces of each length matters for packing, so the plan is made from a histogram of at most `size` rows, whatever the corpus:

1. Reduction (Martello and Toth). A set of pieces that dominates every other set with the same piece is fixed for good: a piece nothing fits beside; a
   pair that fills a sequence exactly; a piece with its largest partner where no other pieces that fit beside it, however many, sum to more than that
   partner. Pieces are tried from the longest to the shortest, again and again until none can be fixed. What is left is a smaller instance with the same
   optimum.
2. Best fit, longest first, for the rest, many equal sequences at a time.

The plan is a list of runs: `count` pieces of one length, from one rank on, go to consecutive sequences at one offset. Ranks are given by rows within
(length, salt) and sums over salts, so a length that a third of all pieces share is ranked by many tasks.

Defined cases: a null text counts as empty and packs as its end id alone; texts longer than a sequence are cut, all other pieces stay whole; repeated
rows are packed each by itself; very long texts, also without spaces, are tokenised in time and memory linear in them; an empty table gives an empty
result; columns other than key and text are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import Memo, settle
from millrace.llm.vec import slabs

#: Bytes of tokenised words kept in a worker; the table is emptied when full.
CACHE_BYTES = 112 << 20
PIECES_PER_SALT = 50_000


#: Letters and digits below U+0250, as Unicode has them, but for the one letter whose lower case is two characters.
LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
PLAIN = re.compile("[\u0021-\u007e\u00a1-\u012f\u0131-\u024f]+")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
END_OF_WORD = b"\xff"


class WordTokens:
    """Ids of whole texts from ids of their words, for tokenizers that drop white space and never merge across it.

    Words of plain Latin characters are split and merged here, with the file's vocabulary as ranks and the end of a word as a byte that no UTF-8
    holds; all others, and those that spell a special token, go to the tokenizers library. Both give what the library gives for the whole text.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in self.lib.get_vocab().items():
            if token not in special:
                stem, end = (token[:-4], END_OF_WORD) if token.endswith("</w>") and len(token) > 4 else (token, b"")
                ranks[bytes(byte_of[c] for c in stem) + end] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = tuple(special)
        self.known = Memo(CACHE_BYTES)

    def _word(self, word: str) -> bytes:
        if not word:
            ids = []
        elif PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            ids = []
            for part in PARTS.findall(word.lower()):
                ids += self.merge(part.encode() + END_OF_WORD)
        else:
            ids = self.lib.encode(word, add_special_tokens=False).ids
        found = array("I", ids).tobytes()
        self.known.keep(word, found, len(found))
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        get, solve = self.known.get, self._word
        return b"".join([i if (i := get(w)) is not None else solve(w) for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")])


_tokens: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer_file: str, size: int, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """key, piece, start, length, ids_crc32: documents as ids with the end id behind, cut where longer than `size`."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens.setdefault(tokenizer_file, None) or WordTokens(tokenizer_file)
        _tokens[tokenizer_file] = own
        for part, _, _ in slabs(batches, text):
            rows: list[list] = [[], [], [], [], []]
            names = part.column(key).to_pylist()
            for name, whole in zip(names, part.column(text).to_pylist()):
                ids = own.ids(whole or "") + end
                for number, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    for column, value in zip(rows, (name, number, at // 4, len(cut) // 4, zlib.crc32(cut))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], part.schema.field(key).type), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]]], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, schema)


def reduce_instance(counts: list[int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], list[int]]:
    """Sets fixed by dominance, as (lengths, how many), and the counts that are left. counts[n] is the number of pieces of length n."""
    left, fixed = list(counts), []

    def fix(lengths: tuple[int, ...], many: int) -> None:
        fixed.append((lengths, many))
        for n in lengths:
            left[n] -= many

    for n in range(size, size // 2, -1):  # exact pairs fill a sequence, which no other set with that piece can better
        many = left[n] if n == size else min(left[n], left[size - n])
        if many:
            fix((n,) if n == size else (n, size - n), many)
    if size % 2 == 0 and left[size // 2] > 1:
        fix((size // 2, size // 2), left[size // 2] // 2)

    def fullest(room: int, n: int) -> int:
        """The largest sum up to `room` of pieces beside one of length n: reachable sums as bits of a number."""
        sums, mask = 1, (1 << room + 1) - 1
        for m in range(1, room + 1):
            many, step = min(left[m] - (m == n), room // m), 1
            while many > 0:
                sums |= sums << m * min(step, many) & mask
                many, step = many - min(step, many), 2 * step
            if sums >> room:
                return room
        return sums.bit_length() - 1

    going = True
    while going:
        going = False
        for n in range(size - 1, 0, -1):
            room = size - n
            while left[n]:
                partner = next((m for m in range(room, 0, -1) if left[m] > (m == n)), 0)
                if not partner:
                    fix((n,), left[n])
                elif fullest(room, n) > partner:
                    break  # some other set with this piece is fuller; the next piece may still have one that dominates
                else:  # no set of the others has a larger sum, and none will have while there are partners of this length
                    fix((n, partner), left[n] // 2 if partner == n else min(left[n], left[partner]))
                going = True
    return fixed, left


def best_fit(counts: list[int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first: (pattern as (length, times) pairs, number of sequences filled so)."""
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: list[tuple[int, int]], many: int) -> None:
        if not many:
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, many))

    for n in range(size, 0, -1):
        todo = counts[n]
        while todo:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                pattern, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, pattern, many = size, [], todo
            each = room // n
            full = min(many, todo // each)
            put(room - each * n, [*pattern, (n, each)], full)
            todo -= full * each
            spare = many - full
            if spare and todo and full < many:
                put(room - todo * n, [*pattern, (n, todo)], 1)
                spare, todo = spare - 1, 0
            if pattern:
                put(room, pattern, spare)
    return [g for room in rooms for g in groups[room]]


def plan(counts: list[int], size: int) -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset), sorted by length and rank; every piece is in exactly one."""
    fixed, left = reduce_instance(counts, size)
    runs, rank, sequence = [], [0] * (size + 1), 0
    for pattern, many in [*(([(n, 1) for n in lengths], k) for lengths, k in fixed), *best_fit(left, size)]:
        offset = 0
        for n, times in pattern:
            for _ in range(times):
                runs.append((n, rank[n], many, sequence, offset))
                rank[n] += many
                offset += n
        sequence += many
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, key: str, rows: int) -> DataFrame:
    """`rank` of each piece among those of its length, from 0, counted within salts and summed over them."""
    salts = max(1, -(-rows // PIECES_PER_SALT))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = salted.withColumn("_within", F.row_number().over(W.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")) - 1)
    return within.join(before, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_salt", "_before", "_within")


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    cut = settle(pieces(docs, tokenizer_file, size, key, text, end_id), "pieces")
    counts = [0] * (size + 1)
    for row in cut.groupBy("length").count().collect():  # at most `size` rows
        counts[row[0]] = row[1]
    runs = plan(counts, size)  # at most `size` runs per group of equal sequences; groups are at most a few per length
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((runs, (runs[:, 0] << 44) + runs[:, 1]))
    out = ranked(cut, key, sum(counts))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, firsts = shared.value
        for b in batches:
            rank = b.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(firsts, (b.column("length").to_numpy(zero_copy_only=False).astype(np.int64) << 44) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, "piece", "start", "length", "ids_crc32")], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return out.select(key, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
