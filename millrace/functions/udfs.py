"""Functions that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@cache
def _may_change_runs() -> list[list[int]]:
    """First and last of each run of characters that a text which is not composed must hold: those that composition replaces, moves or joins to what stands before them."""
    codes = [c for c in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    joined = {ord(x) for c in codes if not 0xAC00 <= c < 0xD7A4 for x in unicodedata.normalize("NFD", chr(c))[1:]}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    found = [c for c in codes if c in joined or c in jamo or unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c)]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return runs


def _class(runs: list[list[int]]) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _may_change() -> str:
    """A pattern of those characters as one class."""
    return _class(_may_change_runs())


def _halved(runs: list[list[int]]) -> str:
    """The same class for Java, which tries the runs of a class one after another for each character: each half behind the range that it lies in."""
    if len(runs) < 4:
        return _class(runs)
    halves = runs[: len(runs) // 2], runs[len(runs) // 2 :]
    return "[" + "".join(f"[{_class([[h[0][0], h[-1][1]]])}&&{_halved(h)}]" for h in halves) + "]"


def composed(text: Column) -> Column:
    """Canonical composition; only texts with a character that it could change leave the JVM."""
    return F.coalesce(nfc(F.when(text.rlike(_halved(_may_change_runs())), text)), text)


@F.pandas_udf(StringType())
def nfd_fold(texts: pd.Series) -> pd.Series:
    """Lower case, decomposed, without marks, for every character; text.fold is the built-in way."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(LongType())
def blake2b_32(texts: pd.Series) -> pd.Series:
    """4-byte BLAKE2b of the UTF-8 bytes as an unsigned number."""
    return texts.map(lambda t: None if t is None else int(hashlib.blake2b(t.encode(), digest_size=4).hexdigest(), 16))
