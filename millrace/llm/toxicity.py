"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, neighbouring pairs and pairs with one or two words between, hashed to 2**bits places. Training goes through a
bounded sample of labelled rows (`most`, a parameter) in one task on an executor, row by row, with a rate for each coordinate; features are made by many tasks
and stream through that one, so long texts are never held together. The L1 term keeps most weights at zero, so what is broadcast for scoring is a sparse list, bounded by 2**bits entries. Scoring is one pass without a shuffle.

A text's logit is the sum of its weights, without regard to its length: a few words make a text toxic however long it is. Scores are then moved by
the threshold that separates the training rows best, so that 0.7 stands for it.

Defined cases: null texts count as empty and score as the model's bias says; repeated rows score alike; with no labelled rows, or one class only, every
score is the share of label 1 (0 without labels); rows with a null key are scored too and count as not held out; very long texts are read whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.features import held_out, labelled_sample, ngrams
from millrace.llm.shared import free, settle
from millrace.llm.vec import slabs

BITS = 20


class Ftrl:
    """FTRL-proximal: z and n for each coordinate; a weight is zero until |z| exceeds l1."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1e-3):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: float) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y
        root = np.sqrt(self.n[at])
        new = np.sqrt(root**2 + g * g)
        self.z[at] += g - (new - root) / self.alpha * w
        self.n[at] += g * g
        step = (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha
        self.bias_z += g - step * b
        self.bias_n += g * g


def cut_point(scores: np.ndarray, y: np.ndarray) -> float:
    """The score between two rows at which the best F1 over the training rows is reached."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.concatenate([scores[order][1:] != scores[order][:-1], [True]])
    k = int(np.argmax(np.where(last, f1, -1)))
    nxt = scores[order][k + 1] if k + 1 < len(y) else scores[order][k] - 1
    return float(scores[order][k] + nxt) / 2


def featured(sample: DataFrame, text: str, bits: int) -> DataFrame:
    """order, y and the feature numbers of each row, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slabs(batches, text, 1 << 20):
            f, at = ngrams(data, off, bits)
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("y"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32)))], ["order", "y", "features"])

    return sample.mapInArrow(run, "order long, y double, features array<int>")


def train(batches: Iterator[pa.RecordBatch], model: Ftrl, bits: int, epochs: int) -> Iterator[pa.RecordBatch]:
    """The model as rows (place, weight): place -1 is the bias, -2 the cut point, -3 the share of label 1.

    Rows come in order, `epochs` times to learn from and once more to be scored, so that none has to be held.
    """
    every, bias, logits, labels = np.zeros(1 << bits), 0.0, [], []
    for b in batches:
        for turn, y, f in zip(b.column("turn").to_pylist(), b.column("y").to_pylist(), b.column("features")):
            found = f.values.to_numpy()
            if turn < epochs:
                model.learn(found, y)
                continue
            if not logits:
                every, bias = model.weights(np.arange(1 << bits)), model.bias()
            logits.append(every[found].sum() + bias)
            labels.append(y)
    places = np.flatnonzero(every)
    y = np.array(labels)
    extra = [bias, cut_point(np.array(logits), y) if 0 < y.sum() < len(y) else 0.0, float(y.mean()) if len(y) else 0.0]
    yield pa.RecordBatch.from_arrays([pa.array([*places.tolist(), -1, -2, -3], pa.int64()), pa.array([*every[places].tolist(), *extra], pa.float64())], ["place", "weight"])


def score(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, key: str = "doc_id", text: str = "text", label: str = "toxic", at: float = 0.7, most: int = 12_000, epochs: int = 2, bits: int = BITS) -> DataFrame:
    """key, held_out, score and predicted for every document."""
    sample = labelled_sample(docs, labels, label, modulus, remainder, most, key, text).select(F.xxhash64(F.col(key), F.lit(5)).alias("order"), F.col(text).alias("text"), "y")
    known = settle(featured(sample, "text", bits), "features")
    l1 = max(2.0, 8.0 * (known.count() / 2700) ** 0.5)  # chance features grow with the rows, and so does the weight they must exceed
    turns = known.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(epochs)))).repartition(1).sortWithinPartitions("turn", "order")
    model = turns.mapInArrow(lambda b: train(b, Ftrl(bits, l1=l1), bits, epochs), "place long, weight double").toArrow()  # at most 2**bits rows come back
    free(known)
    place, weight = model.column("place").to_numpy(), model.column("weight").to_numpy()
    special = dict(zip(place[place < 0].tolist(), weight[place < 0].tolist()))
    share = special.get(-3, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((place[place >= 0].astype(np.int32), weight[place >= 0].astype(np.float32), special.get(-1, 0.0) - special.get(-2, 0.0) + float(np.log(at / (1 - at))), share))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias, share = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[places] = weights
        for part, data, off in slabs(batches, text, 1 << 20):
            f, bounds = ngrams(data, off, bits)
            sums = np.concatenate([[0.0], np.cumsum(dense[f], dtype=np.float64)])
            logit = sums[bounds[1:]] - sums[bounds[:-1]] + bias
            p = np.full(part.num_rows, share) if share in (0.0, 1.0) else 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(p)], [key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(F.col(key), modulus, remainder).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
