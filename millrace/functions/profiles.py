"""Word lists, patterns and thresholds of the corpus and instruction gates."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists of the corpus gate, as they must be for equal results.
CORPUS_TARGET = (
    "yo nan pou ak se li ki gen pa mwen nou te ap sa yon lan la men epi sou tout kòm konsa fè di kap ale vin bay anpil lè yon ou pral kote poukisa paske avèk nap"
)
CORPUS_OTHER = "les des est une dans pour avec sont cette nous vous leur mais plus tout aussi être avoir que qui par sur ses ces elle ils"
# Word lists of the instruction filter (accents folded).
PAIR_TARGET = (
    "yo nan pou ak se li ki gen pa mwen nou te ap sa yon lan la men epi sou tout kom konsa fe di kap ale vin bay anpil le ou pral kote poukisa paske avek nap chak yon ka dwe pi byen anpil"
)
PAIR_OTHER = "les des est une dans pour avec sont cette nous vous leur mais plus tout aussi etre avoir que qui par sur ses ces elle ils vos votre nos avez etes cest dont ainsi"
# Word lists of the instruction report, which are shorter.
REPORT_TARGET = "yo nan pou ak se li ki gen pa mwen nou te ap sa yon lan la men epi sou tout kom konsa fe di kap ale vin bay anpil le ou pral kote poukisa paske avek nap chak"
REPORT_OTHER = "les des est une dans pour avec sont cette nous vous leur mais plus tout aussi etre avoir que qui par sur ses ces elle ils vos votre nos"

# Lexers and patterns. The first has no ò, so words with it fall apart; FIXED_WORDS has it.
CORPUS_WORDS = "[a-zàâçéèêëîïôûùüÿñæœ']+"
FIXED_WORDS = "[a-zàâçéèêëîïôòûùüÿñæœ']+"
FOLDED_WORDS = "[a-z']+"
TRANSLATED = (
    r"tradui[\p{L}\p{N}_]* otomatikman|tradiksyon otomatik|google transl[\p{L}\p{N}_]+|translate\.google|powered by translate|automatically translated"
    r"|machine[- ]translat[\p{L}\p{N}_]+|traduit automatiquement|traducci[oó]n autom[aá]tica"
)
COMMENTARY = r"^(men yo|here are|voici|d[ak]ò|bien s|sure[,!]|of course)"


def words(text: str) -> list[str]:
    """Distinct words of a list, in its order."""
    return list(dict.fromkeys(text.split()))


@dataclass(frozen=True)
class Quality:
    """Thresholds of the quality gate, in the order in which its rules are tried."""

    least_chars: int = 200
    least_words: int = 30
    word_length: tuple[float, float] = (2.0, 12.0)
    least_letters: float = 0.6
    least_distinct_lines: float = 0.75
    most_symbols: float = 0.1


@dataclass(frozen=True)
class Language:
    """Share of function words a document needs, and the lists."""

    target: tuple[str, ...] = tuple(words(CORPUS_TARGET))
    other: tuple[str, ...] = tuple(words(CORPUS_OTHER))
    floor: float = 0.06
    least_words: int = 20


@dataclass(frozen=True)
class Build:
    """One corpus build. `language` and `machine_translation` switch those gates off for corpora in other languages."""

    quality: Quality = Quality()
    language: Language | None = Language()
    machine_translation: bool = True
    dedup_floor: int = 60
    least_fresh: int = 200
    shard_docs: int = 50_000
    bytes_per_token: float = 3.6
    nfc: bool = True
    lexer: str = CORPUS_WORDS


@dataclass(frozen=True)
class Pairs:
    """Thresholds of the instruction filter."""

    instruction: tuple[int, int] = (10, 2000)
    response: tuple[int, int] = (40, 1500)
    floor: float | None = 0.15
    ceiling: float | None = 0.05
    key_chars: int = 160
