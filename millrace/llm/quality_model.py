"""Quality scores: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics of a text (sizes, ratios of character classes, word variety, repetition) are standardised and mapped to `width` random cosines, which
approximate a Gaussian kernel. Each task sums its rows' normal equations into one matrix; the sums, of fixed size, are added and solved on the
driver. The ridge scores of the training rows, in a histogram of fixed size, are made monotone by pooling adjacent violators, which turns a score into the
share of label 1 seen at it. Scoring is one pass without a shuffle.

Training uses the labelled rows that are not held out, from about `most` of them on a sample of that size by a hash of the key; what reaches the driver
is eight sums of matrices of the tasks, and a histogram.

Defined cases: null texts count as empty and are scored like empty ones; repeated rows score alike; without labelled rows every score is 0; rows with a
null key are scored and count as not held out; labels that differ for one key are left out of training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.features import STATISTICS, held_out, labelled_sample, statistics
from millrace.llm.shared import settle
from millrace.llm.vec import slabs

BINS = 2000


class Features:
    """Cosines of random projections of standardised statistics, and 1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: int, gamma: float, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(size=(STATISTICS, width)) * np.sqrt(2 * gamma)
        self.phases = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of equally long vectors of doubles, one from each task, added in groups so that the driver gets a few."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    rows = parts.repartition(8).mapInArrow(add, "v binary").collect()  # eight vectors of fixed size
    return sum((np.frombuffer(r[0]) for r in rows), np.zeros(size))


def isotonic(weights: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Non-decreasing share of positives by bin, by pooling adjacent violators; empty bins take the value below."""
    blocks: list[list[float]] = []
    for w, p in zip(weights.tolist(), positives.tolist()):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and (blocks[-1][0] == 0 or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0] and blocks[-2][0] > 0):
            w2, p2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + p2, blocks[-1][2] + n2]
    return np.repeat([p / w if w else 0.0 for w, p, _ in blocks], [int(n) for _, _, n in blocks])


def score(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, key: str = "doc_id", text: str = "text", label: str = "quality", at: float = 0.3, most: int = 200_000, width: int = 256, gamma: float = 0.05, ridge: float = 1e-3) -> DataFrame:
    """key, held_out, score and predicted for every document."""
    sample = labelled_sample(docs, labels, label, modulus, remainder, most, key, text)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slabs(batches, text):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column("y")], ["x", "y"])

    known = settle(sample.select(text, "y").mapInArrow(describe, "x binary, y double"), "statistics")

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, STATISTICS), batch.column("y").to_numpy(zero_copy_only=False)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * STATISTICS + 1)
        for b in batches:
            if b.num_rows:
                x, _ = matrix(b)
                total += np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    m = _summed(known.mapInArrow(moments, "v binary"), 2 * STATISTICS + 1)
    n = max(m[-1], 1.0)
    mean = m[:STATISTICS] / n
    spread = np.sqrt(np.maximum(m[STATISTICS:-1] / n - mean**2, 1e-9)) + 1e-6
    features = Features(mean, spread, width, gamma)
    size = width + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                x, y = matrix(b)
                f = features(x)
                total += np.hstack([f.T @ f, (f.T @ y)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    e = _summed(known.mapInArrow(equations, "v binary"), size * (size + 1)).reshape(size, size + 1)
    beta = np.linalg.solve(e[:, :size] + ridge * n / size * np.eye(size), e[:, size])

    def bins(raw: np.ndarray) -> np.ndarray:
        return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS)
        for b in batches:
            if b.num_rows:
                x, y = matrix(b)
                k = bins(features(x) @ beta)
                total += np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    h = _summed(known.mapInArrow(histogram, "v binary"), 2 * BINS)
    shares = isotonic(h[:BINS], h[BINS:])
    shared = docs.sparkSession.sparkContext.broadcast((features, beta, shares))  # fixed size
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, beta, shares = shared.value
        for part, data, off in slabs(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(shares[bins(features(statistics(data, off)) @ beta)])], [key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(F.col(key), modulus, remainder).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
