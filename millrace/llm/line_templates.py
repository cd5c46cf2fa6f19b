"""Dropping lines whose template recurs across documents, by a fixed-depth template tree.

A line's path in the tree is its number of tokens and its first DEPTH tokens, or all of them where there are fewer; tokens with a digit are variable
fields, except in lines of fewer than DEPTH tokens that would have no other (a lone number, or a sentence in a script without spaces). A line belongs to
several templates:

* all its tokens, with digits made variable;
* for lines of OPEN tokens or more and without digits, all but one of the first DEPTH: a leading token with many children is variable, and the others
  lead on without it (with digits besides, too little would be constant to tell a template from a way of writing);
* on paths that `min_docs` documents or more take, its tokens that are frequent at their place among the lines of the path, with the others variable.
  Frequent is `min_docs` lines or more, and every power of two from there on that tells the line's tokens apart, so that a word that many lines share is
  still variable beside the words that more lines share. Such a template keeps half of the tokens after the first DEPTH, so that a common beginning alone
  is none.

All are keys of equality, so lines meet by a shuffle instead of one after another.

A template recurs if documents of `min_docs` families hold it, however many documents each family has. A document's family is its component of near
copies among the documents that hold a template of `min_docs` documents, by signatures that the first pass makes beside the keys (near_dedup.families);
whole copied documents are left for the deduplication of documents.

Counts are two-level partial aggregates whose results are written before lines meet them. Up to shared.ROWS of these are broadcast; beyond that lines meet
them in a join that adaptive execution can split, so one very common line is no one task's work either way.

Defined cases: null texts count as empty; lines without a token are kept and never counted; repeated rows with one key count as one document;
rows with a null key are returned unchanged; very long texts are one row of line keys; an empty table gives an empty result; other columns pass
through, except those named like the added ones, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.near_dedup import SKETCH, families, signature
from millrace.llm.shared import ROWS, bounded, free, settle, unused
from millrace.llm.vec import BASE, mix, shingle_hashes, slabs, word_hashes, word_spans

DEPTH = 3
OPEN = 6
#: Documents of which this share of their shingles is common are copies, in percent.
COPIES = 80
VARIABLE = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """The lines with a token of many texts: text number, line number, and which tokens they hold."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.starts, self.ends, self.bounds = word_spans(data, off)
        digits = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
        self.digits = digits
        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
        first = np.searchsorted(self.starts, line_starts)
        count = np.diff(np.concatenate([first, [len(self.starts)]]))
        some = count > 0
        self.begin, self.count = first[some], count[some]
        self.row = np.searchsorted(off, line_starts[some], "right") - 1
        self.number = np.searchsorted(breaks, line_starts[some], "left") - np.searchsorted(breaks, off[self.row], "left")
        # The first DEPTH tokens of each line: the line and the place of each, and the token.
        size = np.minimum(self.count, DEPTH)
        self.of = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.of)) - np.repeat(np.cumsum(size) - size, size)
        self.lead = self.begin[self.of] + self.place
        self.bare = (self.count < DEPTH) & (np.bincount(self.of, weights=self.field(self.lead), minlength=len(size)) == size)

    def field(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens hold a digit."""
        return self.digits[self.ends[tokens]] > self.digits[self.starts[tokens]]

    def hashes(self, tokens: np.ndarray | slice) -> np.ndarray:
        return word_hashes(self.data, self.starts[tokens], self.ends[tokens])

    def values(self, hashes: np.ndarray, field: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hashes of tokens with their places in the line, all variable fields alike."""
        return mix(np.where(field & ~self.bare[line], VARIABLE, hashes) + place.astype(np.uint64) * BASE)

    def paths(self, lead: np.ndarray) -> np.ndarray:
        """The path of each line from the values of its first tokens."""
        total = np.zeros(len(self.count), np.uint64)
        np.add.at(total, self.of, lead)
        return mix(total + self.count.astype(np.uint64))


def paths(docs: DataFrame, text: str) -> DataFrame:
    """The paths of each document's lines, each once; only the first tokens of lines are hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in slabs(batches, text):
            t = Lines(data, off)
            path = t.paths(t.values(t.hashes(t.lead), t.field(t.lead), t.of, t.place))
            order = np.lexsort((path, t.row))
            path, row = path[order], t.row[order]
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(path[new].view(np.int64))], ["path"])

    return docs.select(text).mapInArrow(run, "path long")


LISTS = {"at": "int", "template": "long", "line": "int", "path": "long", "tail": "int", "slots": "array<long>"}


def described(docs: DataFrame, common: Broadcast | None, key: str, text: str) -> DataFrame:
    """A row for each document: its key, a fingerprint of its words, the signature of its shingles, the templates of its lines with the number of the
    line (`at`), and of its lines whose path is in `common`, or of all if that is not known, the number, the path, how many tokens come after the first
    DEPTH (`tail`) and their slots: path, place and token in one hash, without fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slabs(batches, text):
            t = Lines(data, off)
            hashes, tokens = t.hashes(slice(None)), np.arange(len(t.starts))
            line = np.repeat(np.arange(len(t.count)), t.count)
            field = t.field(tokens)
            values = t.values(hashes, field, line, tokens - t.begin[line])
            lead, size = values[t.lead], t.count.astype(np.uint64)
            path = t.paths(lead)
            sums = np.add.reduceat(values, t.begin) if len(values) else np.zeros(0, np.uint64)
            fields = np.bincount(line, weights=field, minlength=len(size))
            may_open = (t.count >= OPEN) & (fields == 0)
            made = np.empty((len(size), 1 + DEPTH), np.uint64)
            made[:, 0] = mix(sums + size)
            for k in range(DEPTH):
                made[:, k + 1] = mix(sums - values[np.minimum(t.begin + k, max(0, len(values) - 1))] + size * BASE + np.uint64(k + 1)) if len(size) else 0
            has = np.ones(made.shape, bool)
            has[:, 1:] = may_open[:, None]
            number = t.number.astype(np.int32)
            at_line = np.repeat(np.arange(len(size)), has.sum(axis=1))
            tail = np.maximum(t.count - DEPTH, 0)
            known = tail > 0 if common is None else (tail > 0) & np.isin(path.view(np.int64), common.value)
            told = ~field & known[line] & (tokens - t.begin[line] >= DEPTH)
            slots = mix(values[told] ^ mix(path)[line[told]]).view(np.int64)
            chosen = np.flatnonzero(known)
            slot_cuts = np.searchsorted(line[told], np.append(chosen, len(path))).astype(np.int32)
            shingles, at = shingle_hashes(hashes, t.bounds)
            words, rows = t.bounds.tolist(), np.arange(part.num_rows + 1)
            template_cuts, line_cuts = (pa.array(np.searchsorted(t.row[x], rows).astype(np.int32)) for x in (at_line, chosen))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).cast(pa.int64()),
                    pa.array([hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(words, words[1:])], pa.binary()),
                    pa.array([signature(shingles[a:b], SKETCH).tobytes() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                    *[pa.ListArray.from_arrays(template_cuts, pa.array(x)) for x in (number[at_line], made[has].view(np.int64))],
                    *[pa.ListArray.from_arrays(line_cuts, pa.array(x)) for x in (number[chosen], path[chosen].view(np.int64), tail[chosen].astype(np.int32))],
                    pa.ListArray.from_arrays(line_cuts, pa.ListArray.from_arrays(pa.array(slot_cuts), pa.array(slots))),
                ],
                ["doc", "set_id", "sig", *LISTS],
            )

    return docs.select(key, text).mapInArrow(run, f"doc long, set_id binary, sig binary, {', '.join(f'{c} array<{kind}>' for c, kind in LISTS.items())}")


def frequent(found: DataFrame, min_docs: int) -> DataFrame:
    """doc, line and template: the frequent tokens of each line, at each power of two that tells them apart."""
    line = ["doc", "line", "path", "tail"]
    each = found.select(*line, F.explode("slots").alias("slot"))
    level = F.floor(F.log2("n")).cast("int")
    often = settle(each.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("slot", level.alias("level")), "slots")
    sets = each.join(bounded(often), "slot").groupBy(*line).agg(F.collect_set(F.struct("level", "slot")).alias("held"))
    levels = sets.withColumn("least", F.explode(F.array_distinct(F.col("held.level"))))
    kept = levels.withColumn("kept", F.array_sort(F.transform(F.filter("held", lambda x: x["level"] >= F.col("least")), lambda x: x["slot"])))
    return kept.where(2 * F.size("kept") >= F.col("tail")).select("doc", "line", F.xxhash64("path", "kept").alias("template"))


def _held_by(rows: DataFrame, what: str, least: int, name: str) -> DataFrame:
    """The values of a column that `least` rows hold, written."""
    return settle(rows.groupBy(what).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(what), name)


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """doc and the numbers (from 0) of its lines whose template recurs."""
    keyed = docs.where(F.col(key).isNotNull())
    common = _held_by(paths(keyed, text), "path", min_docs, "paths")
    few = common.count() <= ROWS
    known = docs.sparkSession.sparkContext.broadcast(np.sort(common.toArrow().column("path").to_numpy())) if few else None  # ROWS numbers at most
    base = settle(described(keyed, known, key, text), "described")
    lines = base.select("doc", F.inline(F.arrays_zip("line", "path", "tail", "slots"))).where("size(slots) > 0")
    by_place = settle(frequent(lines if few else lines.join(common, "path", "left_semi"), min_docs), "templates")
    free(common)
    templates = base.select("doc", F.inline(F.arrays_zip(F.col("at").alias("line"), "template"))).union(by_place)
    often = _held_by(templates.select("template", "doc").distinct(), "template", min_docs, "often")
    held = settle(templates.join(bounded(often), "template", "left_semi"), "held")
    free(by_place, often)
    pairs = held.select("template", "doc").distinct()
    family = families(keyed, base.select("doc", "set_id", "sig").join(held.select("doc").distinct(), "doc", "left_semi"), key, text, percent=COPIES)
    free(base)
    recurring = _held_by(pairs.join(family, "doc").select("template", "family").distinct(), "template", min_docs, "recurring")
    free(family)
    return held.join(bounded(recurring), "template", "left_semi").groupBy("doc").agg(F.collect_set("line").alias("gone"))


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """The input with `text` without recurring lines, and `n_lines` and `n_dropped`."""
    docs = docs.drop("n_lines", "n_dropped")
    doc, gone = unused(docs, "_doc"), unused(docs, "_gone")
    found = recurring_lines(docs, key, text, min_docs).select(F.col("doc").alias(doc), F.col("gone").alias(gone))
    joined = docs.join(found, docs[key] == found[doc], "left")
    whole = F.coalesce(F.col(text), F.lit(""))

    def without(lines: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")

    # The lambda's variable holds the lines, so that a text is split once, and only where lines go.
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.transform(F.array(F.split(whole, "\n")), without)[0])
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    counted = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return counted.withColumn(text, kept).drop(doc, gone)
