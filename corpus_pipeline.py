"""A corpus from documents to packed sequences, in five stages; each works on all that the one before kept.

Each stage's result is to be written before the next stage begins, which then drops the tables that the one before has left in the shared folder.

Defined cases, in every stage: a null text counts as empty, and documents without a word go with the first stage; rows without a doc_id pass the stages that
compare documents (line_dedup and near_dedup leave them as they are, suffix_dedup takes passages from them that others hold); repeated rows are treated
alike and stay as many as they are; very long texts are worked on whole; an empty table gives an empty result; columns other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.line_templates import drop_recurring
from millrace.llm.near_dedup import classes
from millrace.llm.packing import pack
from millrace.llm.quality_rules import apply_rules
from millrace.llm.shared import drop, free, settle, standing
from millrace.llm.suffix_dedup import cut_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Tables of the stage that ran last.
_left: set[str] = set()

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage that drops what the one before has left, and remembers what it leaves itself."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(_left)
        before = standing()
        out = f(spark, docs.select(*COLUMNS), sf_dir)
        _left.clear()
        _left.update(standing() - before)
        return out

    return run


def _has_words(text: str) -> F.Column:
    return F.col(text).rlike(r"[^\x20\x09-\x0D]")


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return apply_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and with them documents in which no word is left."""
    out = drop_recurring(docs).where(_has_words("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, of a similarity of 0.80 or more, the document with the smallest doc_id stays.

    Rows without a doc_id are in no component and stay.
    """
    kept = classes(docs, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds go, and with them documents in which no word is left.

    A cut may fall inside a character; its remaining bytes are dropped with it.
    """
    cut = cut_repeats(docs, carry=("lang", "source"))
    whole = F.coalesce(F.try_validate_utf8("kept"), F.replace(F.make_valid_utf8("kept"), F.lit("\ufffd"), F.lit("")))
    cut = cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(whole))
    return cut.where(_has_words("text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in token sequences of 2048."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate components and tokenizer ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        before, docs = docs, settle(f(spark, docs, sf_dir), name)
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
