"""Byte-level BPE: counts of pre-tokens, from which merges are fitted elsewhere, and applying a tokenizer file. No tokenizer is trained here."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How texts split before merges: contractions, words, numbers and marks with a space before them, and white space.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same splits without going back over long runs.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Characters that are encoded at once, and where a longer text may be cut.
CHUNK = 1 << 16
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pre-tokens and how often each occurs; partial aggregation leaves one row for each and task to shuffle."""
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(PRETOKENS), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch cut to about `limit` bytes of a column, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def chunks(text: str, least: int = CHUNK) -> list[str]:
    """A text in pieces of `least` characters or somewhat more; with nothing to cut at, it stays whole.

    Each cut is before a single space between two characters that are none, where a pre-token begins whatever stands around.
    """
    out, at = [], 0
    while len(text) - at > least and (m := BETWEEN.search(text, at + least)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def ids_of(tokenizer_file: str) -> Callable[[str], Sequence[int]]:
    """Ids of a text as the tokenizers library gives them.

    Files of plain byte-level BPE, whose merges make the ids in their order, are read by tiktoken, which takes a quarter of the time; tests hold it
    against the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file)
    if own.get_vocab_size() > 65_535:
        raise ValueError("this vocabulary does not fit 16 bits")
    told = json.loads(own.to_str())
    model, split = told["model"], told["pre_tokenizer"] or {}
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = told["normalizer"] is None and told["truncation"] is None and told["padding"] is None and not any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    options = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    if model["type"] == "BPE" and byte_level and plain and not options:
        made = [model["vocab"]["".join(m)] for m in model["merges"]]
        if made == sorted(set(made)) and len(made) + 256 == len(set(model["vocab"]) - set(special)) and (not made or made[0] >= 256):
            import tiktoken

            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
            byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            fast = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    return lambda text: own.encode(text, add_special_tokens=False).ids


def encoded(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in `carry` and `ids`, with the end id behind unless that is None; ids that do not fit 16 bits are an error.

    Encodings take some hundred bytes for each token until their ids are read, so texts come a few at a time and in pieces of bounded length.
    """
    names = [key, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    end = np.array([] if end_id is None else [end_id], np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = ids_of(tokenizer_file)

        def ids(whole: str) -> list[np.ndarray]:
            return [np.array(solve(x), np.uint16) for x in chunks(whole)]

        for batch in batches:
            for b in slices(batch, text):
                found = [[*ids(t.as_py() or ""), end] for t in b.column(text)]
                offsets = np.cumsum([0, *(sum(map(len, x)) for x in found)], dtype=np.int32)
                values = np.concatenate([y for x in found for y in x]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*names, "ids"])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, f"{schema}, ids array<int>")
