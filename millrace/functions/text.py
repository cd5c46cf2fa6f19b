"""Text functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space in Unicode strings, by rule.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Line ends besides the line feed.
OTHER_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85  "


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def first_filled(*names: str) -> Column:
    """The first column that is neither null nor empty, or an empty string."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def spaces_collapsed(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t]+", " ")


def blank_lines_collapsed(c: Column) -> Column:
    return F.regexp_replace(c, "\\n{3,}", "\n\n")


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def _menu_line(line: Column) -> Column:
    """Tried from the cheapest test on: few spaces for all characters, then for those of the stripped line."""
    bare, spaces = F.length(strip(line)), count_of(line, " ")
    return (F.length(line) > 120) & (spaces < 0.05 * F.length(line)) & (bare > 120) & (spaces / F.greatest(bare, F.lit(1)) < 0.05)


def clean(c: Column) -> Column:
    """Line ends unified, spaces collapsed, menu lines dropped, blank lines collapsed, stripped. NFC is udfs.composed, before this."""
    unified = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.split(spaces_collapsed(unified), "\n"), lambda line: ~_menu_line(line))
    return strip(blank_lines_collapsed(F.array_join(lines, "\n")))


def clean_small(c: Column) -> Column:
    """The small path's cleaning: a lone carriage return stays, a no-break space becomes a space."""
    unified = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit(" "), F.lit(" "))
    return strip(blank_lines_collapsed(spaces_collapsed(unified)))


def lexed(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def whitespace_words(c: Column) -> Column:
    """Runs of characters that are no Unicode white space."""
    return F.filter(F.split(F.translate(c, WHITE, " " * len(WHITE)), " +"), lambda w: w != "")


def mean_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(F.size(words), F.lit(1))


def letter_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "\\P{L}+", "")) / F.greatest(F.length(c), F.lit(1))


def filled_lines(c: Column) -> Column:
    """Stripped lines that are not empty, at every line end that Unicode knows."""
    split = F.split(F.translate(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), OTHER_BREAKS, "\n" * len(OTHER_BREAKS)), "\n")
    return F.filter(F.transform(split, strip), lambda x: x != "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: a lambda's argument is never inlined into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distinct_share(items: Column) -> Column:
    return _once(items, lambda x: F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))))


def symbol_share(c: Column, words: Column) -> Column:
    return (count_of(c, "#") + count_of(c, "…")) / F.greatest(F.size(words), F.lit(1))


def share_in(words: Column, known: Iterable[str], empty: float = 0.0) -> Column:
    """Share of words in a list; `empty` where there are none."""
    chosen = list(known)
    return F.when(F.size(words) == 0, F.lit(empty)).otherwise(F.size(F.filter(words, lambda w: w.isin(chosen))) / F.greatest(F.size(words), F.lit(1)))


def segments(c: Column) -> Column:
    """struct(segs, sep): stripped lines if there are two or more, else sentences."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    sentences = F.filter(F.transform(F.split(strip(c), "(?<=[.!?])\\s+"), strip), lambda x: x != "")
    many = F.size(lines) > 1
    return F.struct(F.when(many, lines).otherwise(sentences).alias("segs"), F.when(many, F.lit("\n")).otherwise(F.lit(" ")).alias("sep"))


def shingles(words: Column, size: int = 13, step: int = 3) -> Column:
    """Runs of `size` words from every `step`-th word; the last start is before n - size, and short texts have one run."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - size - 1), F.lit(step))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " ")))


@cache
def _folding() -> tuple[str, str]:
    """Letters whose decomposition without marks is one other letter, those letters, and behind the first the marks to delete."""
    single, plain, marks = [], [], []
    for code in range(0xA0, 0xAC00):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != char:
            single.append(char)
            plain.append(bare)
    return "".join(single + marks), "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without accents. Equal to decomposition without marks for all characters below the Hangul syllables."""
    accented, plain = _folding()
    return F.translate(F.lower(c), accented, plain)


def hash_share(c: Column, share: float) -> Column:
    """Whether a text falls into a share of all texts by the first 32 bits of its MD5; the same text always falls alike."""
    return F.substring(F.md5(c), 1, 8) < F.lit(f"{int(share * 2**32):08x}")


def json_array(c: Column) -> Column:
    """From the first '[' to the last ']', or null."""
    start = F.locate("[", c)
    end = F.length(c) - F.locate("]", F.reverse(c)) + 1
    return F.when((start > 0) & (F.locate("]", c) > 0) & (end > start), F.substring(c, start, end - start + 1))
