"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in Spark expressions: the text is split into words and lines once, the measures are scalar expressions over those arrays,
and each row of the table becomes one comparison. No user function runs and no row leaves its scan task, so there is no shuffle.

Defined cases: a null text counts as empty and fails; repeated rows are judged each by itself; an empty table gives an empty result; all columns
of the input may be kept beside the result, and columns with names of the result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The frequent short words of the languages that the rules are for.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as are be at this by from or an not have had his her they you which",
    "fr": "le la les de des du et en un une que qui est pour dans sur par au avec pas plus il elle ce se sont ne on ou",
    "de": "der die das und in zu den von mit für ist im des dem nicht ein eine auf als auch es an sich er werden aus wird bei",
    "es": "el la los las de y en que un una por con para del se no su al es lo como más o pero sus le ha este",
}
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high (an open side is None). Ratios compare products, so they stay in whole numbers."""

    name: str
    top: str
    per: str | None
    low: float | None = None
    high: float | None = None


#: Columns named here are measures below; `per` None means that `top` is compared as it is.
RULES = (
    Rule("too_few_words", "n_words", None, low=50),
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("punctuation", "n_marks", "n_words", high=0.6),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("letters", "n_letters", "word_chars", low=0.6),
    Rule("capitals", "n_capitals", "n_letters", high=0.5),
)
BASE_RULES = ("too_few_words", "repeated_words")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once: a lambda's argument is never inlined into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _twins(windows: Column) -> Column:
    """Places of the windows, given in order as (words, place), that equal a neighbour."""

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    return F.transform(F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | same(x, F.get(windows, i - 1))), lambda x: x["p"])


def repeated_words(words: Column) -> Column:
    """Words inside some 3-word window that occurs twice or more, each word once.

    A first pass sorts one number for each window, 40 bits of its hash and 24 of its place, and keeps the windows that share a hash with a
    neighbour; only those are sorted by their words, so the count is exact. Texts too long for 24 bits skip the first pass. Of the places in
    order, each adds the words up to the next place, three at most.
    """
    n = F.size(words)

    def packed(w: Column, i: Column) -> Column:
        return F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), 24).bitwiseOR(i.cast("long"))

    def shared(x: Column) -> Column:
        def same(y: Column, z: Column) -> Column:
            return F.shiftright(y, 24) == F.shiftright(z, 24)

        found = F.filter(x, lambda y, i: same(y, F.get(x, i + 1)) | same(y, F.get(x, i - 1)))
        return F.transform(found, lambda y: y.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))

    def window(p: Column) -> Column:
        return F.struct(F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p"))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"), p.alias("last")), lambda s: s["sum"])

    likely = F.when(n > 1 << 24, F.sequence(F.lit(0), n - 3)).otherwise(_let(F.sort_array(F.slice(F.transform(words, packed), 1, F.greatest(n - 2, F.lit(0)))), shared))
    return F.when(n < 4, F.lit(0)).otherwise(covered(F.sort_array(_let(F.sort_array(F.transform(likely, window)), _twins))))


def measures(text: Column) -> dict[str, Column]:
    """All measures by name, over columns `_words`, `_lines` and the text itself."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    words, lines = F.col("_words"), F.col("_lines")
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_marks": (F.length(text) - F.length(F.translate(text, "!?|", ""))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long"),
        "n_letters": letters.cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
    }


def verdict(rule: Rule) -> Column:
    """True where the rule is kept."""
    top = F.col(rule.top).cast("double")
    per = F.lit(1.0) if rule.per is None else F.greatest(F.col(rule.per), F.lit(1)).cast("double")
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (top >= F.lit(float(rule.low)) * per)
    if rule.high is not None:
        ok = ok & (top <= F.lit(float(rule.high)) * per)
    return ok


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in `keep` (all, if None) with every measure, `base_failed`, `failed_rules` and `kept`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    made = [*measures(whole), "base_failed", "failed_rules", "kept"]
    stays = [c for c in (docs.columns if keep is None else keep) if c not in made]
    split = docs.select(
        *[F.col(c) for c in stays],
        whole.alias("_text"),
        F.filter(F.split(whole, WORD_BREAK), lambda w: w != "").alias("_words"),
        F.filter(F.split(whole, "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("_lines"),
    )
    # A filter on the verdict must stay above the measures; pushed below, it would repeat each of them. What depends on a row number stays.
    measured = split.select(*[F.col(c) for c in stays], *[c.alias(k) for k, c in measures(F.col("_text")).items()], F.monotonically_increasing_id().alias("_row"))
    failed = F.array_compact(F.array(*[F.when(~verdict(r), F.lit(r.name)) for r in rules]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~base & (F.size("failed_rules") == 0) & (F.col("_row") >= 0)).drop("_row")
