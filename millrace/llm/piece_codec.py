"""SentencePiece encoding and decoding by a merge-type prefix table.

For each prefix of a text the merge process ends in exactly one last token. The table stores it: of the pieces that an Aho-Corasick automaton finds
ending at a place, the last token is the longest whose predecessor (the last token of what stands before it) is compatible with it, that is, the
two spelled together are merged back into just these two. Ids are then recovered from the end of the table. A vocabulary piece holds the space mark
only in front and never a line feed, so texts fall into units that merge independently; units repeat, and each is solved once per worker.

Defined cases: null and empty texts give the begin and end ids only; characters outside the vocabulary become byte pieces; repeated rows are coded
each by itself; a text without spaces is one long unit, worked on in time and memory linear in it; an empty table gives an empty result; other columns
are not read. The model file is a parameter and is never copied.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.shared import Memo
from millrace.llm.vec import slabs

MARK = "▁"
LATIN = "A-Za-z\u00c0-\u024f"
#: Bytes of solved words and of solved units kept in a worker, and pairs tested; each table is emptied when full, so memory stays bounded.
CACHE_BYTES, PAIRS = 112 << 20, 400_000


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as the machine's unsigned 32-bit integers, which must be little-endian")


class PieceCodec:
    """Encodes and decodes with the pieces and scores of one model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.spelled: list[bytes] = [b""] * n
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif lib.is_unknown(i):
                self.spelled[i] = " ⁇ ".encode()
            elif not lib.is_control(i):
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
                self.spelled[i] = piece.replace(MARK, " ").encode()
        self.unit = self._units_of(self.ids)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.sizes = [len(self.pieces.get(i, "")) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self._merged(p) == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._words, self._units = Memo(CACHE_BYTES), Memo(CACHE_BYTES)

    @staticmethod
    def _units_of(pieces: dict[str, int]) -> re.Pattern:
        """A pattern of units; it breaks only between characters that no piece holds side by side."""
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this vocabulary has pieces across words; units would not merge independently")
        latin = re.compile(f"[{LATIN}]")
        beside = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
        held = {b for a, b in beside if latin.match(a)} | {a for a, b in beside if latin.match(b)}
        free = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalpha() and chr(c) not in held)
        return re.compile(f"\n|{MARK}*[{LATIN}]+(?=[{free}{MARK}\n]|$)|{MARK}*[{free}]+(?=[{LATIN}{MARK}\n]|$)|{MARK}*[^{MARK}\n]+|{MARK}+")

    def _merged(self, text: str) -> list[str]:
        """The merge process itself, for strings of one or two pieces: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces, spelled together, are merged back into just these two."""
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pairs[left << 20 | right] = self._merged(a + b) == [a, b]
        return known

    def tokens(self, unit: str) -> list[int] | array:
        """Ids of one unit, by the table of last tokens; a character that no piece covers becomes its bytes."""
        short = len(unit) <= 4096  # lists are faster, arrays are smaller
        last, pairs, compatible = ([-1] if short else array("i", [-1])) * len(unit), self._pairs, self.compatible
        sizes = self.sizes
        for at, piece in self.automaton.iter(unit):
            if last[at] < 0:
                before = at - sizes[piece]
                if before < 0 or (left := last[before]) < 0:
                    last[at] = piece
                elif (ok := pairs.get(left << 20 | piece)) or ok is None and compatible(left, piece):
                    last[at] = piece
        out, i = [] if short else array("I"), len(unit) - 1
        while i >= 0:
            piece = last[i]
            if piece < 0:
                out.extend(self.byte_ids[b] for b in reversed(unit[i].encode()))
                i -= 1
            else:
                out.append(piece)
                i -= sizes[piece]
        return out[::-1]

    def _solve(self, unit: str) -> tuple[bytes, bytes]:
        ids = self.tokens(unit)
        solved = array("I", ids).tobytes(), b"".join(map(self.spelled.__getitem__, ids))
        self._units.keep(unit, solved, len(solved[0]) + len(solved[1]))
        return solved

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """What stands between two single spaces, with the first of them; its units are solved one by one."""
        pairs = [self._units.get(u) or self._solve(u) for u in self.unit.findall(MARK + word)]
        solved = b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
        self._words.keep(word, solved, len(solved[0]) + len(solved[1]))
        return solved

    def encode_spelled(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, begin and end included, and the decoded text in UTF-8."""
        if not text:
            pairs = []
        elif text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
            pairs = [self._units.get(u) or self._solve(u) for u in self.unit.findall(MARK + text.replace(" ", MARK))]
        else:
            get, solve = self._words.get, self._word
            pairs = [get(w) or solve(w) for w in text.split(" ")]
        ids = b"".join([np.uint32(self.begin).tobytes(), *[p[0] for p in pairs], np.uint32(self.end).tobytes()])
        return ids, b"".join([p[1] for p in pairs])[1:]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_spelled(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts in front is taken off, and bytes that are no UTF-8 become U+FFFD."""
        spelled = b"".join(self.spelled[i] for i in ids)
        first = next((i for i in ids if self.spelled[i]), None)
        return spelled[1 if first is not None and spelled[:1] == b" " else 0 :].decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `ids` (binary, little-endian unsigned 32-bit), `decoded` (binary UTF-8) of every whole text."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for part, _, _ in slabs(batches, text):
            coded = [own.encode_spelled(t or "") for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode_documents() reduced to the number of ids and the SHA-256 of ids and decoded text, so that no ids leave the worker."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for part, _, _ in slabs(batches, text):
            coded = [own.encode_spelled(t or "") for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array([len(c[0]) // 4 for c in coded], pa.int64()), *[pa.array([hashlib.sha256(c[k]).hexdigest() for c in coded], pa.string()) for k in (0, 1)]], [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(key, text).mapInArrow(run, schema)
