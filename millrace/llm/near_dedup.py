"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its set of word shingles, a MinHash signature and the hashes
   of its bands. Documents with the same set are one class from here on, so exact copies cost nothing more, however many.
2. Classes that share a band are candidates. In each bucket every class is compared with one centre, the class with the most company over all its
   buckets (for copies of one text, that text itself). That gives the links that join nearly everything, with rows in proportion to the members.
3. What is still apart is compared in full: within buckets that still hold more than one component, members of different components are compared
   block against block, in a task for each pair of blocks, which verifies the survivors itself; only links that join components leave it.
4. The Bayesian test compares signatures a batch at a time. With a uniform prior, after m of n equal values the similarity reaches the threshold with
   probability P(Binomial(n + 1, threshold) <= m); below `miss` the pair is dropped. Survivors are verified on their full shingle sets.
5. Components of the verified links, by distributed star contraction; the smallest key stays.

Bands depend on the threshold: 25 of 5 values at 0.85 and 28 of 4 at 0.80, so that a pair at the threshold shares no band with probability 5e-7 at
most; such a pair fails one of the five tests with probability below 5e-7. No bucket, candidate list or partner list is capped.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a text with fewer words than a shingle has one
shingle; repeated rows have the same key and stay, as they are, in one class; rows with a null key get no row here (the pipeline's
stage keeps them); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import bounded, free, settle
from millrace.llm.vec import LOWER, mix, shingle_hashes, slabs, word_hashes, word_spans

HASHES, BATCH = 125, 25
#: Values in a signature that is for families() only.
SKETCH = 50
_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Members of a bucket compared by one task at most; a larger bucket becomes several pairs of blocks.
BLOCK = 16_384
BLOCK_BYTES = 32 << 20


def document_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, off)
    hashes, at = shingle_hashes(word_hashes(data, starts, ends), bounds, size)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The smallest of `hashes` hash values over a set."""
    best = np.full(hashes, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 4096):
        values = (shingles[None, at : at + 4096] * FACTORS[:hashes, None] + TERMS[:hashes, None]) >> np.uint64(32)
        np.minimum(best, values.min(axis=1).astype(np.uint32), out=best)
    return best


@cache
def shape(percent: int, miss: float = 5e-7) -> tuple[int, int]:
    """Bands and values in a band: the longest bands with which a pair at `percent` shares none with probability `miss` at most."""
    for rows in range(5, 0, -1):
        bands = max(1, math.ceil(math.log(miss) / math.log1p(-min(0.999, (percent / 100) ** rows))))
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band, different for equal values in different bands."""
    x = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        total = mix(total * np.uint64(31) + x[:, k])
    return total.view(np.int64)


@cache
def fewest_equal(threshold: float, miss: float, hashes: int = HASHES) -> tuple[int, ...]:
    """For 25, 50, ... signature values: the fewest equal ones at which the pair is not dropped."""
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surely_linked(threshold: float, miss: float) -> int:
    """The fewest equal values among SKETCH at which the similarity is below the threshold with probability `miss` at most."""
    total = 0.0
    for m in range(SKETCH, -1, -1):
        total += math.comb(SKETCH + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (SKETCH - m)
        if total > miss:
            return m + 1
    return 0


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Of pairs of signatures in equal rows, the numbers of those that no batch drops."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest_equal(threshold, miss, a.shape[1])):
        part = slice(BATCH * k, BATCH * (k + 1))
        equal = equal + (a[left, part] == b[left, part]).sum(axis=1)
        stay = equal >= least
        left, equal = left[stay], equal[stay]
    return left


def describe(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """doc, n_shingles, set_id (null for an empty set) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slabs(batches, text):
            sets = document_sets(data, off, size)
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
                ],
                ["doc", "n_shingles", "set_id", "sig"],
            )

    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, "doc long, n_shingles long, set_id binary, sig binary")


def buckets(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc, band and bucket, a row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = np.concatenate([band_hashes(np.frombuffer(x.as_buffer(), np.uint32), bands, rows) for x in b.column("sig")])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("doc").to_numpy(), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), b.num_rows)), pa.array(found)], ["doc", "band", "bucket"])

    return sigs.select("doc", "sig").mapInArrow(run, "doc long, band int, bucket long")


def full_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """doc, the bytes of its sorted shingle hashes, and their number of bytes in a column of its own, which can be read alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slabs(batches, text):
            sets = [s.tobytes() for s in document_sets(data, off, size)]
            yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["doc", "n_bytes", "shingles"])

    return docs.select(key, text).mapInArrow(run, "doc long, n_bytes long, shingles binary")


def _bayes(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Of pairs (a, b), those that the Bayesian test leaves, and how many values of their signatures are equal."""
    with_both = pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                left = survivors(sa, sb, threshold, miss)
                yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).take(pa.array(left)).columns, pa.array((sa[left] == sb[left]).sum(axis=1).astype(np.int32))], ["a", "b", "equal"])

    return with_both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, equal int")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    with_both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("ha")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (ha, hb) in enumerate(zip(batch.column("ha"), batch.column("hb"))):
                if _linked(np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64), percent):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return with_both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _joins(rows: pa.Table, threshold: float, miss: float, percent: int, values: int) -> pa.Table:
    """Links of one pair of blocks that join different components.

    Every pair of members in different components takes the test, in the first band that the two share only, and survivors are verified on their full
    sets, the most alike first. Pairs whose components a verified link has joined meanwhile need no more links.
    """
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    block = rows.column("block").to_numpy()
    doc, comp = rows.column("doc").to_numpy(), rows.column("component").to_numpy()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    band = int(rows.column("band")[0].as_py())
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    names, number = np.unique(comp, return_inverse=True)
    if i == j:  # all against the members outside the largest component covers every pair of different components
        left = left[number[left] != np.bincount(number).argmax()]
    root = list(range(len(names)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out: tuple[list[int], list[int]] = ([], [])
    step = max(1, (1 << 21) // max(1, len(right)))
    for at in range(0, len(left), step):
        mine = left[at : at + step]
        x, y = np.nonzero(number[mine][:, None] != number[right][None, :])
        a, b = mine[x], right[y]
        ok = np.concatenate([k + survivors(sig[a[k : k + 100_000]], sig[b[k : k + 100_000]], threshold, miss) for k in range(0, len(a), 100_000)] or [np.zeros(0, np.int64)])
        a, b = a[ok], b[ok]
        same = sig[a] == sig[b]
        if band and len(a):
            later = ~same[:, : band * values].reshape(len(a), band, values).all(axis=2).any(axis=1)
            a, b, same = a[later], b[later], same[later]
        for k in np.argsort(-same.sum(axis=1), kind="stable").tolist():
            p, q = int(a[k]), int(b[k])
            u, v = find(int(number[p])), find(int(number[q]))
            if u != v and _linked(sets[p], sets[q], percent):
                root[u] = v
                out[0].append(max(int(doc[p]), int(doc[q])))
                out[1].append(min(int(doc[p]), int(doc[q])))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def crowded(firsts: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc, band, bucket and n, the number of classes in the bucket, where there are more than one."""
    members = buckets(firsts, bands, rows)
    return members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket")


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the centre of each of its buckets."""
    company = members.groupBy("doc").agg(F.sum("n").alias("company"))
    centres = members.join(company, "doc").groupBy("bucket").agg(F.max(F.struct("company", -F.col("doc"))).alias("c")).select("bucket", (-F.col("c.col2")).alias("centre"))
    return members.join(centres, "bucket").where("doc <> centre").select(F.greatest("doc", "centre").alias("a"), F.least("doc", "centre").alias("b")).distinct()


def _firsts(base: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(doc, more, first: the smallest key with the same set, or its own where the set is empty) of all rows, and (doc, sig) of the firsts; both written."""
    groups = settle(base.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc").alias("first")), "groups")
    firsts = settle(base.select("doc", "sig").join(groups.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi").dropDuplicates(["doc"]), "firsts")
    whole = settle(base.select("doc", *more, "set_id").join(groups, "set_id", "left").select("doc", *more, F.coalesce("first", "doc").alias("first")), "whole")
    free(groups)
    return whole, firsts


def _rows_of(docs: DataFrame, keys: DataFrame, key: str, whole: DataFrame) -> DataFrame:
    """The rows with the given keys, one for each; texts are sorted for that only if keys repeat at all."""
    rows = docs.join(bounded(keys), key, "left_semi")
    repeated = whole.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return rows.dropDuplicates([key]) if repeated else rows


def families(docs: DataFrame, base: DataFrame, key: str, text: str, size: int = 5, percent: int = 80, bands: int = 12, miss: float = 0.02) -> DataFrame:
    """doc and family, its component of near copies, of the rows in `base`: (doc, set_id, sig) with SKETCH values in a signature.

    For uses that count groups of copies instead of removing any. Classes are compared with the centre of each bucket; a pair whose posterior leaves
    less than `miss` on either side is decided by that, and the others on their full sets. A pair at the threshold shares no band with probability
    0.002, which leaves no large group apart.
    """
    whole, firsts = _firsts(base)
    members = settle(crowded(firsts, bands, SKETCH // bands), "members")
    judged = settle(_bayes(stars(members), firsts, percent / 100, miss), "stars")
    free(members, firsts)
    unsure = judged.where(f"equal < {surely_linked(percent / 100, miss)}").select("a", "b")
    asked = settle(unsure.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "asked")
    sets = settle(full_sets(_rows_of(docs, asked, key, whole), key, text, size), "full")
    links = settle(judged.where(f"equal >= {surely_linked(percent / 100, miss)}").select("a", "b").union(verified(unsure, sets, percent)), "families")
    free(judged, asked, sets)
    joined = components(links)
    free(links)
    found = whole.join(joined.withColumnRenamed("node", "first"), "first", "left")
    out = settle(found.groupBy("doc").agg(F.min(F.coalesce("component", "first")).alias("family")), "families")
    free(whole, joined)
    return out


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, miss: float = 1e-7) -> DataFrame:
    """key, n_shingles, component_id and kept for every row with a key."""
    threshold = percent / 100
    bands, rows = shape(percent)
    base = settle(describe(docs, key, text, size), "sets")
    whole, firsts = _firsts(base, "n_shingles")
    free(base)
    members = settle(crowded(firsts, bands, rows), "members")
    shared = members.select("doc").distinct()
    sigs = settle(firsts.join(shared, "doc", "left_semi"), "sigs")
    free(firsts)
    likely = settle(_bayes(stars(members), sigs, threshold, miss), "likely")
    sets = settle(full_sets(_rows_of(docs, sigs.select(F.col("doc").alias(key)), key, whole), key, text, size), "full")
    links = settle(verified(likely, sets, percent), "stars")
    free(likely)
    joined = components(links)

    # What the stars left apart: buckets that still hold several components. They are found by numbers alone; only their members' sets travel.
    placed = members.select("doc", "band", "bucket").join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    apart = settle(placed.join(mixed, "bucket", "left_semi").join(sets.select("doc", "n_bytes"), "doc"), "apart")
    free(members)
    sizes = apart.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n_bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    rest = apart.drop("n_bytes").join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rest = rest.join(sigs, "doc").join(sets.select("doc", "shingles"), "doc")
    paired = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", "band", "doc", "component", "sig", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = settle(paired.groupBy("bucket", "i", "j").applyInArrow(lambda t: _joins(t, threshold, miss, percent, rows), "a long, b long").distinct(), "more")
    free(apart, sets, sigs)
    if more.limit(1).count():
        free(joined)
        joined = components(links.union(more))
    free(links, more)

    found = whole.join(joined.withColumnRenamed("node", "first"), "first", "left")
    component = F.coalesce("component", "first")
    return found.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), (F.col("doc") == component).alias("kept"))
