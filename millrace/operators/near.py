"""Exact and near deduplication of small corpora by shared word runs, resolved in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.stage import free, settle


def exact_first(docs: DataFrame) -> DataFrame:
    """`copy`: whether an earlier row has the same text. Digests are aggregated, and the answer comes back by doc_id; rows without one are no copies."""
    first = docs.groupBy(F.md5("text")).agg(F.min("doc_id").alias("_first")).select("_first").distinct()
    joined = docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left")
    return joined.withColumn("copy", F.col("_first").isNull() & F.col("doc_id").isNotNull()).drop("_first")


def shingle_sets(docs: DataFrame, size: int = 13, step: int = 3) -> DataFrame:
    """doc_id and `shingles`, the distinct hashes of its word runs."""
    runs = T.shingles(F.col("_w"), size, step)
    split = docs.select("doc_id", T.whitespace_words(F.col("text")).alias("_w"))  # a column of its own, so that no lambda splits again
    return split.select("doc_id", F.array_distinct(F.transform(runs, lambda s: F.xxhash64(s))).alias("shingles"))


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b), a < b, with Jaccard similarity strictly above the threshold, and the similarity.

    Prefix filter: two sets above the threshold share one of the rarest n - ceil(threshold * n) + 1 members of each, so only these are joined on,
    and members that very many documents hold drop out of the join. Candidates are then verified on their whole sets.
    """
    sets = settle(sets, "shingles")
    members = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    weights = members.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    common = members.join(weights.where("df > 1"), "s")
    singles = common.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    # Members that one document only holds are its rarest and join with nothing; they still use up places of the prefix.
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "s"))
    prefix = common.join(singles, "doc_id").withColumn("place", place + F.col("n") - F.col("shared")).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("doc_id", "n", "s")
    a = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "s")
    b = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "s")
    likely = a.join(b, "s").where((F.col("a") < F.col("b")) & (F.least("na", "nb") > F.greatest("na", "nb") * threshold)).select("a", "b").distinct()
    both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("jaccard", same / (F.size("sa") + F.size("sb") - same)).where(F.col("jaccard") > threshold).select("a", "b", "jaccard")


def resolve(pairs: DataFrame) -> DataFrame:
    """doc_id and `kept` of documents with an earlier neighbour: dropped if one of those is kept, kept if all are dropped.

    The same as going through the documents in order; each round decides all whose earlier neighbours are decided.
    """
    open_pairs = settle(pairs.select("a", "b"), "pairs")
    first = open_pairs.select(F.col("a").alias("doc_id")).join(open_pairs.select(F.col("b").alias("doc_id")), "doc_id", "left_anti").distinct()
    state = first.withColumn("kept", F.lit(True))
    while True:
        known = state.select(F.col("doc_id").alias("a"), "kept")
        told = open_pairs.join(state.select(F.col("doc_id").alias("b")), "b", "left_anti").join(known, "a", "left")
        now = told.groupBy("b").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_and(F.col("kept").isNotNull()).alias("all")).where("hit OR all")
        new = settle(now.select(F.col("b").alias("doc_id"), (~F.col("hit")).alias("kept")), "decided")
        if new.isEmpty():
            free(new)
            return state.join(open_pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")
        before, state = state, settle(state.unionByName(new), "state")
        free(before, new)


def prepared(docs: DataFrame, threshold: float = 0.8, least_chars: int = 200) -> DataFrame:
    """doc_id, cleaned text and outcome (short, copy, near copy, kept) of every document."""
    cleaned = settle(docs.select("doc_id", T.clean_small(F.col("text")).alias("text")), "cleaned")
    short = cleaned.where(F.length("text") < least_chars).withColumn("outcome", F.lit("short"))
    marked = exact_first(cleaned.where(F.length("text") >= least_chars))
    copies = marked.where("copy").drop("copy").withColumn("outcome", F.lit("copy"))
    distinct = marked.where(~F.col("copy")).drop("copy")
    decided = resolve(near_pairs(shingle_sets(distinct), threshold)).where(~F.col("kept")).select("doc_id", F.lit("near copy").alias("outcome"))
    rest = distinct.join(decided, "doc_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("kept")))
    return short.unionByName(copies).unionByName(rest.select(short.columns))
