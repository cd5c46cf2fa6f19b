"""Building one deduplicated corpus from prioritised sources, with a reason for every dropped document.

Rows come as (priority, doc_ord, source, text). "First" is always by (priority, doc_ord) and, for segments, the place in the document. Both
deduplications are exact minimum aggregates, so partial aggregation absorbs a text or line that very many documents hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.profiles import Build
from millrace.functions.udfs import composed
from millrace.operators import gates
from millrace.sources.stage import ranges, settle

ORDER = ("priority", "doc_ord")
LAST = 2**31 - 1


def with_order(docs: DataFrame) -> DataFrame:
    """Driver tables in the engine's order: the number in the source's name, then the key. Sources without a number come last."""
    return docs.select(F.coalesce(F.substring("source", 4, 10).try_cast("int"), F.lit(LAST)).alias("priority"), F.col("doc_id").alias("doc_ord"), "source", "text")


def gated(docs: DataFrame, b: Build) -> DataFrame:
    """Cleaned text and the reason of the quality, language and translation gates."""
    cleaned = docs.withColumn("text", composed(F.coalesce("text", F.lit("")))) if b.nfc else docs
    cleaned = cleaned.withColumn("text", T.clean(F.col("text"))).withColumn("words", T.lexed(F.col("text"), b.lexer))
    reason = gates.quality_reason(F.col("text"), F.col("words"), b.quality)
    if b.language:
        reason = F.coalesce(reason, F.when(~gates.language_ok(F.col("words"), b.language), "not kreyol"))
    if b.machine_translation:
        reason = F.coalesce(reason, F.when(gates.says_translated(F.col("text")), "machine translated"))
    return cleaned.withColumn("reason", reason).drop("words")


def _told(rows: DataFrame, firsts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`name`: whether a row's keys are among `firsts`, nulls being equal. Rows with the same keys are told the same."""
    found = firsts.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_first", F.lit(True))
    same = [rows[k].eqNullSafe(found[f"_{k}"]) for k in keys]
    return rows.join(found, same, "left").withColumn(name, F.coalesce("_first", F.lit(False))).drop("_first", *[f"_{k}" for k in keys])


def passed(docs: DataFrame, b: Build) -> DataFrame:
    """Rows that pass all gates. All rows are written with their reason first, so that no filter repeats the work behind it."""
    return settle(gated(docs, b), "gated").where("reason IS NULL")


def first_documents(docs: DataFrame) -> DataFrame:
    """`first_document`: whether no earlier row has the same text.

    Only digests and order columns are aggregated; the answer comes back by the order columns, so a text that very many rows share is no hot key.
    """
    keyed = docs.select(*ORDER, F.md5("text").alias("_digest"))
    first = keyed.groupBy("_digest").agg(F.min(F.struct(*ORDER)).alias("_f")).select("_f.*")
    return _told(docs, first, [*ORDER], "first_document")


def exploded_segments(docs: DataFrame) -> DataFrame:
    """Order columns, `sep`, `pos` and `seg` of every segment."""
    return docs.withColumn("_s", T.segments(F.col("text"))).select(*ORDER, F.col("_s.sep").alias("sep"), F.posexplode("_s.segs").alias("pos", "seg"))


def fresh_segments(segments: DataFrame, floor: int) -> DataFrame:
    """`fresh`: short segments, and the first occurrence of each long one over all documents.

    A segment of a document that is dropped later still counts as seen, so one pass decides.
    """
    long = F.length("seg") >= floor
    first = segments.where(long).groupBy(F.md5("seg")).agg(F.min(F.struct(*ORDER, "pos")).alias("_f")).select("_f.*")
    return _told(segments, first, [*ORDER, "pos"], "fresh").withColumn("fresh", ~long | F.col("fresh"))


def build(docs: DataFrame, b: Build = Build()) -> DataFrame:
    """Every input row with `reason` (null where kept), `partly_duplicate` and, where kept, the deduplicated `text`.

    `reason_detail` tells exact copies from documents with too little fresh text.
    """
    rows = settle(gated(docs, b), "gated")  # cleaned once, used by both deduplications
    first = settle(first_documents(rows.where("reason IS NULL")), "first")
    segs = fresh_segments(settle(exploded_segments(first.where("first_document")), "segments"), b.dedup_floor)
    joined = segs.groupBy(*ORDER).agg(
        F.max("sep").alias("_sep"),
        F.count(F.lit(1)).alias("_all"),
        F.count_if("fresh").alias("_fresh"),
        F.coalesce(F.sum(F.when(F.col("fresh"), F.length("seg"))), F.lit(0)).alias("_chars"),
        F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("pos", "seg")))).alias("_segs"),
    )
    done = first.drop("reason").join(joined, list(ORDER), "left")
    detail = F.when(~F.col("first_document"), "copy").when(F.coalesce("_chars", F.lit(0)) < b.least_fresh, "little fresh text")
    done = done.withColumn("reason_detail", detail).withColumn("reason", F.when(detail.isNotNull(), "duplicate"))
    kept = F.array_join(F.transform("_segs", lambda s: s["seg"]), "\n")
    kept = F.when(F.col("_sep") == " ", F.array_join(F.transform("_segs", lambda s: s["seg"]), " ")).otherwise(kept)
    done = done.withColumn("partly_duplicate", F.col("reason").isNull() & (F.col("_fresh") < F.col("_all"))).withColumn("text", F.when(F.col("reason").isNull(), kept))
    dropped = rows.where("reason IS NOT NULL").select(*ORDER, "source", F.lit(None).cast("string").alias("text"), "reason", F.col("reason").alias("reason_detail"), F.lit(False).alias("partly_duplicate"))
    return done.select(dropped.columns).unionByName(dropped)


def manifest(built: DataFrame, b: Build = Build()) -> DataFrame:
    """One row: documents, characters, estimated tokens and shards."""
    kept = built.where("reason IS NULL").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("characters"))
    return kept.withColumn("estimated_tokens", F.floor(F.col("characters") / b.bytes_per_token)).withColumn("shards", F.ceil(F.col("documents") / F.lit(b.shard_docs)))


def source_counts(built: DataFrame) -> DataFrame:
    """By source and reason, with read, chars and partly duplicate as rows of their own."""
    reasons = gates.reason_counts(built, "source")
    totals = built.groupBy("source").agg(
        F.count(F.lit(1)).alias("read"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.length("text"))), F.lit(0)).cast("long").alias("chars"), F.count_if("partly_duplicate").alias("partly duplicate")
    )
    return reasons.unionByName(totals.unpivot("source", ["read", "chars", "partly duplicate"], "reason", "n"))


def ranked(df: DataFrame, order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """`rank` from 0 in a total order without one task for all rows: ranges first, then counts before each range."""
    from pyspark.sql import Window as W

    # Written once: two computations of the ranges could draw their bounds differently.
    ranged = settle(df.repartitionByRange(parts or ranges(df), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    sums = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_b")  # one row for each range
    return within.join(F.broadcast(before), "_part").withColumn("rank", F.col("_b") + F.col("_n")).drop("_part", "_n", "_b", "_c")


def shards(built: DataFrame, b: Build = Build()) -> DataFrame:
    """Kept documents with the number of the shard that each goes to."""
    return ranked(built.where("reason IS NULL"), ORDER).withColumn("shard", F.floor(F.col("rank") / b.shard_docs).cast("int"))
