"""Splits and packing of a token stream into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.stage import ranges, settle


def hash_split(docs: DataFrame, share: float = 0.005, text: str = "text") -> DataFrame:
    """`split`: val for a share of all texts by their hash, else train."""
    return docs.withColumn("split", F.when(T.hash_share(F.col(text), share), "val").otherwise("train"))


def count_split(docs: DataFrame, share: float = 0.05, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """`split`: the first max(1, round half even(n * share)) documents of a seeded hash order are val."""
    from millrace.operators.corpus import ranked

    n = docs.count()
    order = docs.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return ranked(order, ("_h", key)).withColumn("split", F.when(F.col("rank") < max(1, round(n * share)), "val").otherwise("train")).drop("_h", "rank")


def blocks(docs: DataFrame, block: int = 1024, parts: int | None = None) -> DataFrame:
    """split, block_id, ids: token streams (arrays `ids`, the end id last) of each split in doc_id order, cut at `block`; the last partial block goes.

    Offsets are prefix sums in two levels: within ranges of doc_id, and over the totals of the ranges, of which there are `parts`, or as many as the cluster shuffles to.
    """
    # Written once: two computations of the ranges could draw their bounds differently.
    ranged = settle(docs.select("split", "doc_id", "ids").repartitionByRange(parts or ranges(docs), "doc_id").withColumn("_part", F.spark_partition_id()).withColumn("_n", F.size("ids").cast("long")), "ranges")
    inside = W.partitionBy("split", "_part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("split", "_part").agg(F.sum("_n").alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(W.partitionBy("split").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("split", "_part", "_b")
    placed = ranged.withColumn("_o", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before), ["split", "_part"]).withColumn("_o", F.col("_o") + F.col("_b"))
    # Slices of documents, one for each block they reach into, so no token is a row of its own.
    first, last = F.floor(F.col("_o") / block), F.floor((F.col("_o") + F.col("_n") - 1) / block)
    cut = placed.withColumn("block_id", F.explode(F.sequence(first, last))).withColumn("_from", F.greatest(F.lit(0), F.col("block_id") * block - F.col("_o")))
    size = F.least(F.col("_n"), (F.col("block_id") + 1) * block - F.col("_o")) - F.col("_from")
    cut = cut.withColumn("_slice", F.slice("ids", (F.col("_from") + 1).cast("int"), size.cast("int"))).withColumn("_at", F.col("_o") + F.col("_from"))
    joined = cut.groupBy("split", "block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_slice"))), lambda s: s["_slice"])).alias("ids"))
    return joined.where(F.size("ids") == block)


def chosen_blocks(packed: DataFrame, rows: DataFrame) -> DataFrame:
    """The blocks whose (split, block_id) is in `rows`."""
    return packed.join(rows, ["split", "block_id"], "left_semi")


def text_blocks(docs: DataFrame, ids: Column, block: int, most: int, key: str = "doc_id") -> DataFrame:
    """key, block_id, ids: the first `most` whole blocks of each text by itself; `ids` is its token array."""
    n = F.least(F.floor(F.size("_ids") / block), F.lit(most))
    each = docs.select(key, ids.alias("_ids")).where(F.size("_ids") >= block).withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return each.select(key, "block_id", F.slice("_ids", (F.col("block_id") * block + 1).cast("int"), F.lit(block)).alias("ids"))


def tokenizer_split(docs: DataFrame, held_out: int = 2_000, fitted: int = 400_000, *order: str) -> DataFrame:
    """`part`: the first documents in order are for measuring a tokenizer, the next for fitting it, and the others for neither."""
    from millrace.operators.corpus import ranked

    part = F.when(F.col("rank") < held_out, "measured").when(F.col("rank") < held_out + fitted, "fitted").otherwise("neither")
    return ranked(docs, order or ("doc_id",)).withColumn("part", part).drop("rank")


def manifest(tokens: DataFrame, block: int) -> DataFrame:
    """By split: documents, tokens, blocks, and the tokens that whole blocks keep and leave; from (split, n_tokens). A split of less than a block is an error."""
    n = F.sum("n_tokens")
    sums = tokens.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), n.alias("tokens"), F.floor(n / block).alias("blocks"), (n - n % block).alias("tokens_kept"), (n % block).alias("tokens_dropped"))
    checked = F.assert_true(F.col("blocks") >= 1, F.concat(F.lit("less than one block of tokens in split "), F.col("split")))
    return sums.withColumn("blocks", F.when(checked.isNull(), F.col("blocks")))
