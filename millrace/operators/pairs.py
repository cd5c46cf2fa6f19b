"""Instruction pairs: reading them from turns and replies, filtering, deduplicating and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.profiles import FOLDED_WORDS, PAIR_OTHER, PAIR_TARGET, REPORT_OTHER, REPORT_TARGET, Pairs, words
from millrace.operators.gates import pair_reason


def from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): a user's turn and the assistant's next."""
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(answer, ["conv_id", "turn"])


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Pairs in the JSON array of each reply; elements that are no objects and objects with an empty field give none."""
    array = F.try_parse_json(T.json_array(F.col(reply)))
    rows = replies.withColumn("_v", array).where("_v IS NOT NULL AND schema_of_variant(_v) LIKE 'ARRAY%'")
    each = rows.selectExpr("*", "posexplode(CAST(_v AS ARRAY<VARIANT>)) AS (pos, value)")
    field = lambda name: T.strip(F.try_variant_get(F.col("value"), f"$.{name}", "string"))
    out = each.select(*[c for c in replies.columns if c != reply], F.col("pos"), field("enstriksyon").alias("instruction"), field("repons").alias("response"))
    return out.where("instruction <> '' AND response <> ''")


def rejected(pairs: DataFrame, p: Pairs = Pairs()) -> DataFrame:
    return pairs.withColumn("reason", pair_reason(F.col("instruction"), F.col("response"), words(PAIR_TARGET), words(PAIR_OTHER), p))


def deduplicated(pairs: DataFrame, order: tuple[str, ...], p: Pairs = Pairs()) -> DataFrame:
    """The first pair, in order, of each folded and shortened instruction."""
    first = pairs.groupBy(F.substring(T.fold(F.col("instruction")), 1, p.key_chars)).agg(F.min(F.struct(*order)).alias("_f"))
    return pairs.join(first.select("_f.*"), list(order), "left_semi")


def report(pairs: DataFrame) -> DataFrame:
    """One row of totals over instruction, response, domain and task."""
    lexed = F.regexp_extract_all(T.fold(F.concat_ws(" ", "instruction", "response")), F.lit(FOLDED_WORDS), F.lit(0))
    rows = pairs.withColumn("_w", lexed).withColumn("_a", T.share_in(F.col("_w"), words(REPORT_TARGET))).withColumn("_b", T.share_in(F.col("_w"), words(REPORT_OTHER))).withColumn("_n", -F.length("response"))
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.coalesce(F.avg("_a"), F.lit(0.0)), 4).alias("kreyol_word_rate"),
        F.round(F.coalesce(F.avg("_b"), F.lit(0.0)), 4).alias("french_word_rate"),
        F.count_if(F.col("response").rlike("[^\\x00-\\x7F]")).alias("with_accents"),
        F.count_distinct("instruction").alias("unique_instructions"),
        # The upper of two middle values: the lower one of the negated values.
        F.expr("CAST(-percentile_disc(0.5) WITHIN GROUP (ORDER BY _n) AS BIGINT)").alias("median_response_chars"),
    )


def per_task(pairs: DataFrame, task: str, order: tuple[str, ...], chars: int = 32) -> DataFrame:
    """Rows by shortened task, most first, ties by the first seen in the given order; `place` is from 1.

    `order` has to tell rows apart. What is ranked is one row for each task.
    """
    counts = pairs.groupBy(F.substring(task, 1, chars).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "_first"))).drop("_first")


def samples(pairs: DataFrame, order: tuple[str, ...], n: int = 5, instruction: int = 170, response: int = 280) -> DataFrame:
    """The first pairs in order, shortened for a report."""
    return pairs.orderBy(*order).limit(n).select(*order, F.substring("instruction", 1, instruction).alias("instruction"), F.substring("response", 1, response).alias("response"))
