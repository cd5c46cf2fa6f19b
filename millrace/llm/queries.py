"""The queries of this folder by name, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import load


#: The queries in order of their operators.
NAMES = ("op1_vector_search", "op2_language_id", "op3_piece_codec", "op4_best_fit_packing", "op5_toxicity", "op6_quality_rules", "op7_near_dedup", "op8_quality_model", "op9_suffix_dedup", "op10_line_templates")


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.vector_search import neighbours

    return neighbours(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language_id import predictions

    return predictions(load(spark, sf_dir, "documents"), spans=False).select("doc_id", "held_out", "lang_pred", "score")


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.piece_codec import digest_documents

    return digest_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.packing import pack

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_rules import apply_rules

    out = apply_rules(load(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import score

    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), 3, 1)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_model import score

    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), 5, 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near_dedup import classes

    return classes(load(spark, sf_dir, "documents"), percent=85)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_dedup import cut_repeats

    return cut_repeats(load(spark, sf_dir, "documents"), digest=True)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_templates import drop_recurring

    return drop_recurring(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
