import unicodedata

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import udfs
from millrace.functions.profiles import CORPUS_WORDS, FIXED_WORDS


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first()[0]


def test_clean(spark):
    assert one(spark, "a\r\nb\rc \t d\n\n\n\ne  ", T.clean) == "a\nb\nc d\n\ne"
    menu, prose = "x" * 121, "x" * 115 + " x x x x x x x"
    assert one(spark, f"{menu}\n{prose}", T.clean) == prose
    assert one(spark, None, T.clean) == ""
    assert one(spark, "a\r b\r\nc d", T.clean_small) == "a\r b\nc d"


def test_words_and_shares(spark):
    assert one(spark, "Kòm avèk l'ap 12", lambda c: T.lexed(c, CORPUS_WORDS)) == ["k", "m", "avèk", "l'ap"]
    assert one(spark, "Kòm", lambda c: T.lexed(c, FIXED_WORDS)) == ["kòm"]
    assert one(spark, " a  b\x1cc\n", T.whitespace_words) == ["a", "b", "c"]
    assert one(spark, "ab1é", T.letter_share) == 0.75
    assert one(spark, "", T.letter_share) == 0.0
    assert one(spark, "a\x0bb\ra", lambda c: T.distinct_share(T.filled_lines(c))) == 2 / 3


def test_segments(spark):
    got = one(spark, "One. Two!Three? Four", T.segments)
    assert got["segs"] == ["One.", "Two!Three?", "Four"] and got["sep"] == " "
    got = one(spark, " a \n\n b. c ", T.segments)
    assert got["segs"] == ["a", "b. c"] and got["sep"] == "\n"


def test_shingle_starts(spark):
    for n, starts in ((1, [0]), (13, [0]), (14, [0]), (16, [0]), (17, [0, 3]), (20, [0, 3, 6])):
        words = [str(i) for i in range(n)]
        assert one(spark, " ".join(words), lambda c: T.shingles(F.split(c, " "))) == [" ".join(words[s : s + 13]) for s in starts]


def test_fold(spark):
    for s in ("Éléphant ÑANDÚ", "łódź", "Ǻḗ", "é", "plain"):
        want = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
        assert one(spark, s, T.fold) == want
        assert one(spark, s, udfs.nfd_fold) == want
    assert one(spark, "é", udfs.nfc) == "é"


def test_json_array(spark):
    assert one(spark, 'x [1, 2] y', T.json_array) == "[1, 2]"
    assert one(spark, "] [", T.json_array) is None
    assert one(spark, "none", T.json_array) is None


def test_composition_tries_few_runs(spark):
    """The halved class holds the same characters as the plain one, and a text is searched in the time of a few runs, not of all of them."""
    import time

    plain, halved = udfs._may_change(), udfs._halved(udfs._may_change_runs())
    every = spark.createDataFrame([(chr(c),) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3200 or c % 16 == 0 or unicodedata.normalize("NFC", chr(c)) != chr(c))], "c string")
    assert every.where(F.col("c").rlike(plain) != F.col("c").rlike(halved)).count() == 0
    rows = spark.createDataFrame([("Yon ti peyi. " * 1_000_000,)], "c string").select(udfs.composed(F.col("c")).alias("c")).select(F.length("c"))
    rows.collect()
    began = time.time()
    assert rows.first()[0] == 13_000_000 and time.time() - began < 8


def test_menu_lines_at_their_bounds(spark):
    lines = [edge + "x " * k + "x" * (n - 2 * k) + edge for n in (119, 120, 121, 140) for k in (0, 5, 6, 7, 8) for edge in ("", " ", "\u00a0\u00a0")]
    menu = [len(x.strip()) > 120 and x.count(" ") / len(x.strip()) < 0.05 for x in lines]
    got = spark.createDataFrame(list(enumerate(f"a\n{x}\nb" for x in lines)), "n long, c string").select("n", T.clean(F.col("c")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == {n: "a\nb" if m else f"a\n{x}\nb" for n, (x, m) in enumerate(zip(lines, menu))} and any(menu) and not all(menu)
