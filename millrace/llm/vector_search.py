"""Approximate nearest neighbours by adaptive dimension scans over inverted lists.

Vectors are scaled to length 1 and turned by one random rotation, so that a part of the coordinates stands for all of them. A coarse quantiser (k-means on
a bounded sample, a tenth of the rows at most) deals all rows into about sqrt(n) lists. Vectors are compared in column blocks, a few dimensions of many
vectors and many queries together: after d of D dimensions, a candidate whose partial distance, scaled by D/d, exceeds the query's bound by the factor
(1 + epsilon / sqrt(d)) squared is abandoned, the test that its full distance is larger at that confidence. Survivors get the cosine of the original
vectors in double precision.

A query first scans its nearest lists, as many as hold k + 1 vectors, without a bound. The k-th distance found there, or within the sample where that is
smaller, bounds the scan of its other lists, and the bound shrinks as each group of vectors is done. The sample gives bounds only, never results.

`probe` is the share of lists scanned. Left out, it is measured on the sample: the share that holds `recall` of the neighbours that sampled rows have within
the sample. Clustered vectors need few lists; directions without clusters need most of them, and the tests on partial distances do the saving then.

Equal vectors are indexed as the k + 1 rows with the smallest ids, which is all that k neighbours with ties to smaller ids can need, so one vector that a third
of all rows share is a few rows; equal queries are searched once. A list longer than BLOCK vectors is scanned in blocks, and one that more than ASKED queries
probe in chunks of queries, by different tasks.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers take no part; rows with a null
id neither; fewer candidates than k give fewer rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import free, settle

BLOCK, ASKED = 8192, 4096
#: Vectors and queries compared at once.
GROUP, TOGETHER = 1024, 512
COLUMNS = 16
EPSILON = 2.1


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of equal rows in double precision, the same for the same two rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Index:
    """Rotation, list centres and the sample they come from; its size is bounded by the sample's."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, probe: float | None, recall: float, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0].astype(np.float32)
        self.turned = self.turn(sample)
        lists = int(max(1, min(round(rows**0.5), len(sample) // 8)))
        centres = self.turned[rng.permutation(len(sample))[:lists]].copy()
        for _ in range(8):
            near = self.nearest(self.turned, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, self.turned)
            some = np.bincount(near, minlength=lists) > 0
            centres[some] = sums[some] / np.maximum(np.linalg.norm(sums[some], axis=1, keepdims=True), 1e-12)
        self.centres = centres
        self.probes = max(1, int(np.ceil((self._share(k, recall) if probe is None else probe) * lists)))

    def turn(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (x @ self.rotation).astype(np.float32)

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def _share(self, k: int, recall: float) -> float:
        """The share of lists within which `recall` of the sample's neighbours of some of its rows are found."""
        some = self.turned[:400]
        near = some @ self.turned.T
        near[np.arange(len(some)), np.arange(len(some))] = -np.inf
        k = min(k, len(self.turned) - 1)
        if k < 1:
            return 1.0
        found = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(some @ self.centres.T), axis=1), axis=1)
        ranks = np.take_along_axis(order, self.nearest(self.turned, self.centres)[found], axis=1)
        return float(np.quantile(ranks, recall) + 1) / len(self.centres)


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the queries and vectors of all pairs that no test abandons. `bound` has a distance for each query; it shrinks to the k-th found."""
    dim = x.shape[1]
    edges = [*range(0, dim, COLUMNS), dim]
    bound, best = bound.astype(np.float64), np.full((len(q), k), np.inf)
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]

    def holds(d: np.ndarray, done: int, limit: np.ndarray) -> np.ndarray:
        return d * (dim / done) <= limit * (1 + EPSILON / np.sqrt(done)) ** 2 if done < dim else d <= limit * (1 + 1e-4) + 4e-6

    for a in range(0, len(x), GROUP):
        part, first = x[a : a + GROUP], edges[1]
        d = (part[:, :first] ** 2).sum(axis=1)[None, :] + (q[:, :first] ** 2).sum(axis=1)[:, None] - 2 * (q[:, :first] @ part[:, :first].T)
        i, j = np.nonzero(holds(d, first, bound[:, None]))
        d = d[i, j]
        for low, high in zip(edges[1:-1], edges[2:]):
            gap = part[j, low:high] - q[i, low:high]
            d = d + np.einsum("ij,ij->i", gap, gap)
            stay = holds(d, high, bound[i])
            i, j, d = i[stay], j[stay], d[stay]
        order = np.lexsort((d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        more = np.full((len(q), k), np.inf)
        more[i[place < k], place[place < k]] = d[place < k]
        best = np.sort(np.hstack([best, more]), axis=1)[:, :k]
        bound = np.minimum(bound, best[:, k - 1])
        for column, v in zip(found, (i, j + a, d)):
            column.append(v)
    i, j, d = (np.concatenate(c) for c in found)
    stay = holds(d, dim, bound[i])
    return i[stay], j[stay]


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and `raw` (doubles as bytes) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    present = rows.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
    good = present.where(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("v") == (sizes[0] if sizes else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + 0.0  # -0.0 becomes 0.0
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "raw"])

    return good.mapInArrow(pack, "id long, raw binary")


def search(vectors: pa.Table, asked: pa.Table, index: Index, k: int) -> pa.Table:
    """The k nearest vectors of one block for each query of one chunk, as far as no bound excludes them."""
    out: list[list[np.ndarray]] = [[], [], []]
    if vectors.num_rows and asked.num_rows:
        raw, names = _floats(vectors.column("raw")), vectors.column("id").to_numpy()
        x = index.turn(raw)
        queries, bounds = asked.column("q").to_numpy(), asked.column("bound").to_numpy()
        for a in range(0, len(queries), TOGETHER):
            mine = _floats(asked.column("qraw").slice(a, TOGETHER))
            i, j = scan(x, index.turn(mine), bounds[a : a + TOGETHER], k)
            s = np.concatenate([cosines(mine[i[b : b + 65_536]], raw[j[b : b + 65_536]]) for b in range(0, len(i), 65_536)] or [np.zeros(0)])
            order = np.lexsort((names[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            for column, v in zip(out, (queries[a + i[top]], names[j[top]], s[top])):
                column.append(v)
    q, found, s = (np.concatenate(c) if c else [] for c in out)
    return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(s, pa.float64())})


def neighbours(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, probe: float | None = None, recall: float = 0.985, sample: int | None = None, sample_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, id and score of the k nearest rows found for each query row; is_query is a condition on the column `id`."""
    spark = rows.sparkSession
    good = settle(usable(rows, key, vector), "vectors")
    window = W.partitionBy("raw").orderBy("id")
    indexed = settle(good.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k + 1).drop("_n"), "indexed")
    queries = settle(good.where(is_query), "queries")
    free(good)
    asked = queries.groupBy("raw").agg(F.min("id").alias("q"))

    n = indexed.count()
    first = indexed.first()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    most = max(1, min(max(n // 10, 32), round(40 * n**0.5), sample_bytes // len(first[1]), sample or n))
    share = int(min(1.0, most / n) * (1 << 40))
    drawn = indexed.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 40)) < share).limit(2 * most).toArrow()  # bounded by `most` up to chance
    if not drawn.num_rows:
        drawn = indexed.limit(most).toArrow()
    index = Index(_floats(drawn.column("raw"))[np.argsort(drawn.column("id").to_numpy())], n, k, probe, recall)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), pa.array(own.nearest(own.turn(_floats(b.column("raw"))), own.centres).astype(np.int32))], ["id", "raw", "list"])

    placed = settle(indexed.mapInArrow(place, "id long, raw binary, list int"), "lists")
    free(indexed)
    lengths = np.zeros(len(index.centres), np.int64)
    for a, c in placed.groupBy("list").count().collect():  # one row for each list
        lengths[a] = c
    sizes = spark.sparkContext.broadcast(lengths)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its bound, once for every list it scans: the nearest ones, or, where a first bound is given, the others."""
        own, length = shared.value, sizes.value
        for b in batches:
            if not b.num_rows:
                continue
            x = own.turn(_floats(b.column("raw")))
            order = np.argsort(-(x @ own.centres.T), axis=1, kind="stable")
            seeds = (np.cumsum(length[order], axis=1) < k + 1).sum(axis=1) + 1
            if "found" in b.schema.names:
                d = 2 - 2 * (x @ own.turned.T)
                inside = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(x), np.inf)
                bound = np.minimum(2 - 2 * b.column("found").to_numpy(zero_copy_only=False), inside + 1e-6)
                chosen = [o[s : max(s, own.probes)] for o, s in zip(order, seeds)]
            else:
                bound = np.full(len(x), np.inf)
                chosen = [o[:s] for o, s in zip(order, seeds)]
            chosen = [c[length[c] > 0] for c in chosen]
            row = np.repeat(np.arange(len(x)), [len(c) for c in chosen])
            yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(row)), b.column("raw").take(pa.array(row)), pa.array(bound[row]), pa.array(np.concatenate(chosen).astype(np.int32))], ["q", "qraw", "bound", "list"])

    def found_in(wanted: DataFrame, name: str) -> DataFrame:
        """Nearest vectors of the lists that queries scan, in blocks of vectors and chunks of queries; vectors go to every chunk of their list."""
        probes = wanted.mapInArrow(probed, "q long, qraw binary, bound double, list int")
        asked_of = probes.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        probes, asked_of = settle(probes, "probes"), settle(asked_of.select("list", F.ceil(F.col("n") / ASKED).cast("int").alias("chunks")), "chunks")
        of_list = F.broadcast(spark.createDataFrame([(a, -(-c // BLOCK)) for a, c in enumerate(lengths.tolist())], "list int, blocks int").join(asked_of, "list"))  # one row for each list
        vectors = placed.join(of_list, "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        sent = probes.join(of_list, "list").withColumn("chunk", F.pmod(F.xxhash64("q"), "chunks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = lambda v, a: search(v, a, shared.value, k + 1)
        by = ("list", "block", "chunk")
        out = settle(vectors.drop("blocks", "chunks").groupBy(*by).cogroup(sent.drop("blocks", "chunks").groupBy(*by)).applyInArrow(own, "q long, id long, score double"), name)
        free(probes, asked_of)
        return out

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k + 1)

    parts = spark.sparkContext.defaultParallelism * 2
    near = found_in(asked.repartition(parts, "q"), "near")
    bounds = best_of(near).groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(-1.0)).alias("found"))
    far = found_in(asked.join(bounds, "q").repartition(parts, "q"), "far")
    best = best_of(near.union(far)).drop("_n")
    # Back from distinct queries to query rows; a row is no neighbour of itself.
    each = queries.withColumnRenamed("id", "query_id").join(asked, "raw").select("query_id", "q").join(best, "q").where("id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
