"""Queries over the driver's tables. The SQL that each is held against is in plans.oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import udfs
from millrace.functions.profiles import CORPUS_WORDS, Build, Language, Pairs
from millrace.operators import corpus, gates, glue, metrics, near, packing, pairs, prompts
from millrace.plans import oracles
from millrace.plans.inline import BLOCK_LOSSES, CHECKS, CONFIGS, ENDINGS, HISTORY, MADE, PAGES, REPLIES, RUNS, SCORED, SCORED_TEXTS, SOURCES, TOKEN_COUNTS, VOCABULARIES, WINDOWS
from millrace.sources import readers, writers
from millrace.sources.stage import settle, shared_dir
from millrace.sources.tables import load, spread

#: The documents are in other languages than the default gate asks for, so later stages are exercised without it.
OPEN = Build(language=None, machine_translation=False)
LOOSE = Pairs(response=(40, 4000), floor=None, ceiling=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"), "doc_id")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_order(documents(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", T.clean(F.col("text"))).withColumn("words", T.lexed(F.col("text"), CORPUS_WORDS))


def clean_lengths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(T.clean(F.col("text"))).cast("long").alias("n"), F.md5(T.clean(F.col("text"))).alias("digest"))


def clean_small_lengths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(T.clean_small(F.col("text"))).cast("long").alias("n"), F.md5(T.clean_small(F.col("text"))).alias("digest"))


def word_stats(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", F.size("words").cast("long").alias("n_words"), F.round(T.mean_length(F.col("words")), 6).alias("mean_length"))


def whitespace_word_stats(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.whitespace_words(F.col("text"))).cast("long").alias("n_words"))


def text_features(spark, sf_dir):
    c = F.col("text")
    return _cleaned(spark, sf_dir).select("doc_id", F.round(T.letter_share(c), 6).alias("letters"), F.round(T.distinct_share(T.filled_lines(c)), 6).alias("distinct_lines"), F.round(T.symbol_share(c, F.col("words")), 6).alias("symbols"))


def quality_reasons(spark, sf_dir):
    return corpus.gated(ordered(spark, sf_dir), OPEN).select(F.col("doc_ord").alias("doc_id"), "source", "reason")


def quality_reasons_by_source(spark, sf_dir):
    return gates.reason_counts(corpus.gated(ordered(spark, sf_dir), OPEN), "source")


def language_rates(spark, sf_dir):
    p = Language()
    return _cleaned(spark, sf_dir).select("doc_id", F.round(T.share_in(F.col("words"), p.target), 6).alias("target"), F.round(T.share_in(F.col("words"), p.other), 6).alias("other"))


def language_gate(spark, sf_dir):
    return gates.reason_counts(corpus.gated(ordered(spark, sf_dir), replace(OPEN, language=Language())))


def mt_disclosure(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", gates.says_translated(F.col("text")).alias("says_translated"))


def doc_dedup(spark, sf_dir):
    return corpus.first_documents(corpus.passed(ordered(spark, sf_dir), OPEN)).select(F.col("doc_ord").alias("doc_id"), "first_document")


def segment_counts(spark, sf_dir):
    s = T.segments(F.col("text"))
    return _cleaned(spark, sf_dir).select("doc_id", F.size(s["segs"]).cast("long").alias("n_segments"), (s["sep"] == "\n").alias("by_line"))


def _fresh(spark, sf_dir):
    first = corpus.first_documents(corpus.passed(ordered(spark, sf_dir), OPEN)).where("first_document")
    return corpus.fresh_segments(settle(corpus.exploded_segments(first), "segments"), OPEN.dedup_floor)


def segment_dedup(spark, sf_dir):
    return _fresh(spark, sf_dir).groupBy(F.col("doc_ord").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh"))


def segment_reuse_by_source(spark, sf_dir):
    return _fresh(spark, sf_dir).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fresh")).alias("repeated"))


def corpus_build(spark, sf_dir):
    built = corpus.build(ordered(spark, sf_dir), OPEN)
    return built.select(F.col("doc_ord").alias("doc_id"), "reason", "reason_detail", "partly_duplicate", F.md5("text").alias("digest"))


def corpus_manifest(spark, sf_dir):
    return corpus.manifest(corpus.build(ordered(spark, sf_dir), OPEN), OPEN)


def corpus_source_counts(spark, sf_dir):
    return corpus.source_counts(corpus.build(ordered(spark, sf_dir), OPEN))


def shard_assignment(spark, sf_dir):
    return corpus.shards(corpus.build(ordered(spark, sf_dir), OPEN), replace(OPEN, shard_docs=100)).select(F.col("doc_ord").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "shard")


def _distinct_small(spark, sf_dir):
    cleaned = settle(documents(spark, sf_dir).select("doc_id", T.clean_small(F.col("text")).alias("text")), "cleaned")
    return near.exact_first(cleaned.where(F.length("text") >= 200)).where(~F.col("copy"))


def shingle_counts(spark, sf_dir):
    return near.shingle_sets(_distinct_small(spark, sf_dir)).select("doc_id", F.size("shingles").cast("long").alias("n"))


def near_dup_pairs(spark, sf_dir):
    return near.near_pairs(near.shingle_sets(_distinct_small(spark, sf_dir)), 0.5).withColumn("jaccard", F.round("jaccard", 6))


def near_dedup_kept(spark, sf_dir):
    return near.prepared(documents(spark, sf_dir), 0.3).select("doc_id", "outcome")


def prepare_summary(spark, sf_dir):
    return near.prepared(documents(spark, sf_dir), 0.8).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def hash_split_counts(spark, sf_dir):
    return packing.hash_split(documents(spark, sf_dir), 0.05).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


def count_split(spark, sf_dir):
    return packing.count_split(documents(spark, sf_dir), 0.05).select("doc_id", "split")


def held_out_documents(spark, sf_dir):
    held = documents(spark, sf_dir).where((F.length("text") >= 1500) & T.hash_share(F.col("text"), 0.05))
    return held.select("doc_id", F.length("text").cast("long").alias("n")).orderBy("doc_id").limit(400)


def exclude_sources(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(~F.coalesce("source", F.lit("")).isin("src3", "src7")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def survey_totals(spark, sf_dir):
    sized = load(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes_memory"))
    surveyed = metrics.survey(sized.withColumn("bytes_files", F.lit(None).cast("long")).withColumn("note", F.when(F.col("source") == "src19", "EVALUATION ONLY").otherwise("crawl")))
    return metrics.survey_totals(surveyed)


def survey_table(spark, sf_dir):
    return metrics.survey(spark.createDataFrame(SOURCES, "source string, bytes_memory long, bytes_files long, note string")).select("source", "bytes", F.col("tokens").cast("long").alias("tokens"), "evaluation")


def _word_ids(spark, sf_dir):
    """Token streams for a check in SQL: the length of each word stands for its id, and 0 ends a document."""
    ids = F.concat(F.transform(T.whitespace_words(F.col("text")), F.length), F.array(F.lit(0)))
    return packing.hash_split(documents(spark, sf_dir), 0.05).select("doc_id", "split", ids.alias("ids"))


def pack_blocks(spark, sf_dir):
    return packing.blocks(_word_ids(spark, sf_dir), 256).select("split", "block_id", F.aggregate("ids", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("digest"))


def pack_remainder(spark, sf_dir):
    n = F.sum(F.size("ids"))
    return _word_ids(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("documents"), n.alias("tokens"), F.floor(n / 256).alias("blocks"), (n % 256).alias("dropped"))


def sft_pairs(spark, sf_dir):
    found = pairs.from_turns(load(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", F.length("instruction").cast("long").alias("n_instruction"), F.length("response").cast("long").alias("n_response"))


def sft_reject_reasons(spark, sf_dir):
    return gates.reason_counts(pairs.rejected(pairs.from_turns(load(spark, sf_dir, "conversations"))))


def sft_reject_reasons_loose(spark, sf_dir):
    return gates.reason_counts(pairs.rejected(pairs.from_turns(load(spark, sf_dir, "conversations")), LOOSE))


def sft_dedup(spark, sf_dir):
    return pairs.deduplicated(pairs.from_turns(load(spark, sf_dir, "conversations")), ("conv_id", "turn"), Pairs(key_chars=12)).select("conv_id", "turn")


def sft_report(spark, sf_dir):
    return pairs.report(pairs.from_turns(load(spark, sf_dir, "conversations")))


def sft_per_task(spark, sf_dir):
    found = pairs.from_turns(load(spark, sf_dir, "conversations")).withColumn("task", F.substring("instruction", 1, 1))
    return pairs.per_task(found, "task", ("conv_id", "turn")).withColumn("place", F.col("place").cast("long"))


def prompt_grid(spark, sf_dir):
    return prompts.grid(spark).withColumn("job", F.col("job").cast("long"))


def prompt_texts(spark, sf_dir):
    return prompts.grid(spark).select(F.col("job").cast("long").alias("job"), F.md5(prompts.prompt(F.col("domain"), F.col("task"), F.col("angle"))).alias("digest"))


def parse_json_pairs(spark, sf_dir):
    return pairs.parsed(spark.createDataFrame(REPLIES, "id long, reply string")).withColumn("pos", F.col("pos").cast("long"))


def position_profile(spark, sf_dir):
    return metrics.position_profile(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", init=0.125).withColumn("tail_mean", F.round("tail_mean", 6))


def lr_schedule(spark, sf_dir):
    return spark.range(1000).select(F.col("id").alias("step"), F.round(metrics.learning_rate(F.col("id"), 1000, 6e-4, 100) * 1e6, 6).alias("rate"))


def position_bands(spark, sf_dir):
    return metrics.position_bands(spark.createDataFrame(SCORED, "model string, doc_id long, pos int, loss double, hit boolean"), 512, "model").select("model", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.round("loss", 6).alias("loss"), F.round("hit", 6).alias("hit"))


def bits_per_character(spark, sf_dir):
    out = metrics.bits_per_character(spark.createDataFrame(SCORED_TEXTS, "model string, loss double, tokens long, characters long"), "model")
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("bits_per_character", "perplexity_per_token", "tokens_per_character")])


def prefix_match(spark, sf_dir):
    run, share = metrics.prefix_match(F.split("made", " "), F.split("real", " "))
    return spark.createDataFrame(MADE, "id long, made string, real string").select("id", run.cast("long").alias("run"), F.round(share, 6).alias("share"))


def training_stop(spark, sf_dir):
    return metrics.patience(spark.createDataFrame(HISTORY, "run string, step long, loss double"), 3).withColumn("waited", F.col("waited").cast("long"))


def blake2b_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", (udfs.blake2b_32("text") < int(0.05 * 2**32)).alias("held_out"))


def sentence_glue(spark, sf_dir):
    return glue.glued(documents(spark, sf_dir)).select("source", "doc_ord", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def bpe_fertility(spark, sf_dir):
    import public_tokenizers

    from millrace.operators import tokenizer

    docs = documents(spark, sf_dir).withColumn("words", F.size(T.whitespace_words(F.col("text"))))
    counts = tokenizer.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=None, carry=("words",)).select(F.size("ids").alias("tokens"), "words")
    return metrics.fertility(counts)


def pretoken_counts(spark, sf_dir):
    from millrace.operators import tokenizer

    return tokenizer.pretoken_counts(documents(spark, sf_dir)).groupBy(F.length("token").alias("chars")).agg(F.count(F.lit(1)).alias("distinct_tokens"), F.sum("n").alias("tokens"))


def streaming_dedup(spark, sf_dir):
    from millrace.streaming import seen

    schema = load(spark, sf_dir, "documents").schema
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    seen.run_once(spark, f"{sf_dir}/documents.parque[t]", schema, f"{where}/out", f"{where}/state")
    return spark.read.parquet(f"{where}/out").select("digest")


def clean_composed(spark, sf_dir):
    """The build's cleaning with composition, over texts whose accents have been taken apart."""
    apart = F.replace(F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00fc"), F.lit("u\u0308"))
    gated = corpus.gated(ordered(spark, sf_dir).withColumn("text", apart), OPEN)
    return gated.select(F.col("doc_ord").alias("doc_id"), F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def source_head(spark, sf_dir):
    return readers.head(load(spark, sf_dir, "documents"), 5, "doc_id", by="source").select("doc_id", "source")


def source_registry(spark, sf_dir):
    known = readers.registered(spark, [(f"src{k}", f"{sf_dir}/documents.parquet", k % 5 == 0) for k in range(20)], ["src7", "src3", "none", "src5"])
    rows = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return known.join(rows, "source", "left").select("priority", "source", "sentences", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def source_configs(spark, sf_dir):
    return metrics.configs(load(spark, sf_dir, "documents"), "source", "lang")


def survey_document(spark, sf_dir):
    return metrics.survey_document(metrics.survey(spark.createDataFrame(SOURCES, "source string, bytes_memory long, bytes_files long, note string")))


def nearest_configs(spark, sf_dir):
    names = spark.createDataFrame(CONFIGS, "dataset string, config string").groupBy("dataset").agg(F.collect_set("config").alias("names"))  # a dataset's few configurations
    return names.select("dataset", F.array_join(metrics.nearest_configs(F.col("names")), ",").alias("near"))


def published_summary(spark, sf_dir):
    return readers.published(spark.createDataFrame(PAGES, "name string, text string"))


def pack_manifest(spark, sf_dir):
    return packing.manifest(_word_ids(spark, sf_dir).select("split", F.size("ids").cast("long").alias("n_tokens")), 256)


def pack_source_counts(spark, sf_dir):
    return packing.hash_split(documents(spark, sf_dir), 0.05).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("split") == "val").alias("held_out"))


def block_subset(spark, sf_dir):
    packed = packing.blocks(_word_ids(spark, sf_dir), 256)
    rows = packed.select("split", "block_id").where("block_id % 7 = 3")
    return packing.chosen_blocks(packed, rows).select("split", "block_id", F.aggregate("ids", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


def scoring_blocks(spark, sf_dir):
    """Blocks that texts are scored by: of the first 400,000 characters, 40 at most; that is the feature."""
    ids = F.transform(T.whitespace_words(F.substring("text", 1, 400_000)), F.length)
    return packing.text_blocks(documents(spark, sf_dir), ids, 64, 40).select("doc_id", "block_id", F.aggregate("ids", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


def tokenizer_split(spark, sf_dir):
    return packing.tokenizer_split(documents(spark, sf_dir).select("doc_id"), 100, 500, "doc_id")


def sft_samples(spark, sf_dir):
    return pairs.samples(pairs.from_turns(load(spark, sf_dir, "conversations")), ("conv_id", "turn"))


def sft_output(spark, sf_dir):
    """What the sink of instruction pairs holds: written, and read again strictly."""
    where = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    writers.pairs(pairs.from_turns(load(spark, sf_dir, "conversations")), where, 50, "conv_id", "turn")
    rows = spark.read.schema("instruction string, response string").option("mode", "FAILFAST").json(where)
    return rows.select(F.md5("instruction").alias("instruction"), F.md5("response").alias("response"))


def token_output(spark, sf_dir):
    """What the flat token files hold: written in pieces, and read again."""
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    writers.token_files(packing.blocks(_word_ids(spark, sf_dir), 256), where)
    parts = [readers.token_blocks(spark, f"{where}/{split}/*.bin", 256).withColumn("split", F.lit(split)) for split in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.aggregate("ids", F.lit(0), lambda a, x: a + x)).cast("long").alias("total"))


def block_perplexity(spark, sf_dir):
    return metrics.block_perplexity(spark.createDataFrame(BLOCK_LOSSES, "part string, block_id long, loss double"), "part").withColumn("perplexity", F.round("perplexity", 6))


def held_out_loss(spark, sf_dir):
    return metrics.held_out_loss(spark.createDataFrame(BLOCK_LOSSES, "part string, block_id long, loss double"), 10, 4, "part").withColumn("loss", F.round("loss", 6))


def window_losses(spark, sf_dir):
    found = metrics.window_losses(spark.createDataFrame(WINDOWS, "model string, doc_id long, start int, tokens long, loss double"), (0, 600), 64, "model")
    return found.select("model", F.col("start").cast("long").alias("start"), F.when(~F.isnan("loss"), F.round("loss", 6)).alias("loss"), "texts")


def stop_rate(spark, sf_dir):
    return metrics.stop_rate(spark.createDataFrame(ENDINGS, "model string, last_id int, end_id int, prompt_tokens int, tokens int, most_new int"), "model")


def end_id_check(spark, sf_dir):
    return spark.createDataFrame(VOCABULARIES, "model string, end_id int, vocabulary int").select("model", metrics.can_end(F.col("end_id"), F.col("vocabulary")).alias("can_end"))


def training_throughput(spark, sf_dir):
    rows = spark.createDataFrame(CHECKS, "run string, step long, first_step long, total_steps long, tokens_per_step long, seconds double")
    return metrics.throughput(rows).withColumn("hours_left", F.round("hours_left", 6))


def training_arithmetic(spark, sf_dir):
    return metrics.training_arithmetic(spark.createDataFrame(RUNS, "run string, blocks long, block long, batch long, accumulation long, epochs double, parameters long"))


def model_comparison(spark, sf_dir):
    bits = metrics.bits_per_character(spark.createDataFrame(SCORED_TEXTS, "model string, loss double, tokens long, characters long"), "model")
    long = bits.unpivot("model", ["bits_per_character", "perplexity_per_token", "tokens_per_character"], "measure", "value").withColumn("value", F.round("value", 6))
    return metrics.compared(long, ["new", "old"])


def fertility_delta(spark, sf_dir):
    counts = spark.createDataFrame(TOKEN_COUNTS, "tokenizer string, tokens long, words long").groupBy("tokenizer").agg((F.sum("tokens") / F.greatest(F.sum("words"), F.lit(1))).alias("fertility"))
    mine, theirs = F.max(F.when(F.col("tokenizer") == "mine", F.col("fertility"))), F.max(F.when(F.col("tokenizer") == "theirs", F.col("fertility")))
    return counts.agg(F.round(mine, 6).alias("mine"), F.round(theirs, 6).alias("theirs"), F.round(metrics.fertility_delta(mine, theirs), 6).alias("delta"))


NAMES = (
    "clean_lengths clean_small_lengths word_stats whitespace_word_stats text_features quality_reasons quality_reasons_by_source language_rates language_gate mt_disclosure doc_dedup segment_counts segment_dedup"
    " segment_reuse_by_source corpus_build corpus_manifest corpus_source_counts shard_assignment shingle_counts near_dup_pairs near_dedup_kept prepare_summary hash_split_counts count_split held_out_documents"
    " exclude_sources survey_totals survey_table pack_blocks pack_remainder sft_pairs sft_reject_reasons sft_reject_reasons_loose sft_dedup sft_report sft_per_task prompt_grid prompt_texts parse_json_pairs"
    " position_profile lr_schedule position_bands bits_per_character prefix_match training_stop blake2b_split sentence_glue bpe_fertility pretoken_counts streaming_dedup clean_composed"
    " source_head source_registry source_configs survey_document nearest_configs published_summary pack_manifest pack_source_counts block_subset scoring_blocks tokenizer_split sft_samples sft_output token_output"
    " block_perplexity held_out_loss window_losses stop_rate end_id_check training_throughput training_arithmetic model_comparison fertility_delta"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
