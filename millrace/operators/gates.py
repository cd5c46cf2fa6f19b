"""Ordered gates that give each dropped row the first reason that applies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.profiles import COMMENTARY, FOLDED_WORDS, TRANSLATED, Language, Pairs, Quality


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, or null."""
    (condition, reason), *rest = cases
    return reduce(lambda c, case: c.when(case[0], case[1]), rest, F.when(condition, reason))


def quality_reason(text: Column, words: Column, q: Quality = Quality()) -> Column:
    lines = T.filled_lines(text)
    mean = T.mean_length(words)
    return first_reason(
        (F.length(text) < q.least_chars, "too short"),
        (F.size(words) < q.least_words, "too few words"),
        ((mean < q.word_length[0]) | (mean > q.word_length[1]), "word length"),
        (T.letter_share(text) < q.least_letters, "not enough letters"),
        (T.distinct_share(lines) < q.least_distinct_lines, "repeated lines"),
        (T.symbol_share(text, words) > q.most_symbols, "symbols"),
    )


def language_ok(words: Column, p: Language = Language()) -> Column:
    target, other = T.share_in(words, p.target), T.share_in(words, p.other)
    return (F.size(words) >= p.least_words) & (target >= p.floor) & (target > other)


def says_translated(text: Column) -> Column:
    return F.lower(text).rlike(TRANSLATED)


def pair_reason(instruction: Column, response: Column, target: list[str], other: list[str], p: Pairs = Pairs()) -> Column:
    """Why an instruction pair is dropped, or null."""
    words = F.regexp_extract_all(T.fold(F.concat(instruction, F.lit(" "), response)), F.lit(FOLDED_WORDS), F.lit(0))
    cases = [
        (~F.length(instruction).between(*p.instruction), "instruction length"),
        (~F.length(response).between(*p.response), "response length"),
        (response.rlike(f"(?iu){COMMENTARY}"), "teacher commentary"),
    ]
    if p.floor is not None:
        cases.append((T.share_in(words, target, 0.0) < p.floor, "not kreyol enough"))
    if p.ceiling is not None:
        cases.append((T.share_in(words, other, 1.0) > p.ceiling, "french"))
    return first_reason(*cases)


def reason_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows by reason (kept where null) and the given columns."""
    return df.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
