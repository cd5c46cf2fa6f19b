"""Memory that does not follow the longest text, tables that are dropped, and rows that are out of the ordinary."""

import hashlib
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def _grown(f):
    """Result and MB by which the process has grown at its peak."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = f()
    return out, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3


def test_memo_counts_bytes():
    from millrace.llm.shared import Memo

    memo = Memo(10_000)
    for k in range(1000):
        memo.keep(f"word{k}", b"x" * 50, 50)
        assert sum(len(v) + 4 * len(n) + Memo.OVERHEAD for n, v in memo.items()) <= 10_000
    memo.keep("y" * 65, b"", 0)
    assert "y" * 65 not in memo and "word999" in memo


def test_texts_without_spaces_leave_nothing_in_memory():
    from millrace.llm.packing import WordTokens
    from millrace.llm.piece_codec import PieceCodec

    rng = np.random.default_rng(1)
    codec, words = PieceCodec(P.path("piece_bpe_32k.model")), WordTokens(P.path("word_bpe_49k.json"))
    for _ in range(40):
        t = bytes(rng.integers(97, 123, 5_000, dtype=np.uint8)).decode()
        codec.encode_spelled(t)
        words.ids(t)
    assert all(len(k) <= 64 for memo in (codec._words, codec._units, words.known) for k in memo)


@pytest.mark.parametrize("unit", ["x", "ab", "語", "the quick fox "])
def test_codecs_on_long_texts(unit):
    import sentencepiece
    from tokenizers import Tokenizer

    from millrace.llm.packing import WordTokens
    from millrace.llm.piece_codec import PieceCodec

    t = unit * (300_000 // len(unit))
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids, text = PieceCodec(P.path("piece_bpe_32k.model")).encode_spelled(t)
    want = lib.encode(t, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want and text.decode() == lib.decode(want)
    own = np.frombuffer(WordTokens(P.path("word_bpe_49k.json")).ids(t), "<u4").tolist()
    assert own == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids


def test_codecs_on_twenty_megabytes():
    from millrace.llm.packing import WordTokens
    from millrace.llm.piece_codec import PieceCodec

    t = "abcdefghij" * 2_000_000
    codec, words = PieceCodec(P.path("piece_bpe_32k.model")), WordTokens(P.path("word_bpe_49k.json"))
    (ids, text), more = _grown(lambda: codec.encode_spelled(t))
    assert text.decode() == t and len(ids) > 8 and more < 1500
    got, more = _grown(lambda: words.ids(t))
    assert len(got) % 4 == 0 and more < 3000


def test_spans_of_a_long_text():
    from millrace.llm.suffix_dedup import Slab

    t = bytes(np.random.default_rng(0).integers(97, 123, 20_000_000, dtype=np.uint8)).decode()
    rows = pa.table({"key": pa.array([1, 2], pa.int64()), "text": pa.array([t, t[5_000_000:5_000_500]])})
    slab, more = _grown(lambda: Slab(rows, 50, 16))
    content, again = _grown(lambda: slab.content(np.arange(len(slab.starts))))
    assert np.isin(content[slab.docs == 1], content[slab.docs == 0]).sum() >= (slab.docs == 1).sum() - 2
    assert more + again < 1000


def test_languages_of_a_long_text_beside_short_ones():
    from millrace.llm import language_id as L
    from millrace.llm.vec import buffers

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, (3, 1 << L.BITS)).astype(float)
    model = L.Model(["a", "b", "c"], counts, np.ones((3, L.OTHER + 1)), np.ones(3), 1.0)
    word = lambda: bytes(rng.integers(97, 123, 6, dtype=np.uint8)).decode()
    texts = [" ".join(word() for _ in range(250_000)), *[" ".join(word() for _ in range(4)) for _ in range(8_000)]]
    data, off = buffers(pa.array(texts))
    found, more = _grown(lambda: list(L.label(model, data, off)))
    alone = [next(iter(L.label(model, *buffers(pa.array([t]))))) for t in (texts[0], texts[1], texts[-1])]
    assert more < 1000 and all((found[k][2] == a[2]).all() for k, a in zip((0, 1, -1), alone))


@pytest.mark.parametrize("name", ["language_id", "toxicity", "quality_model", "piece_codec", "packing", "suffix_dedup", "line_templates", "vector_search"])
def test_empty_and_clashing(spark, name):
    """An empty table gives an empty result; columns named like helper columns change nothing."""
    rows = [(i, t, "en", "s", 3) for i, t in enumerate(["one two three four five six", None, "", "one two three four five six", "x" * 100_000])]
    docs, clash = spark.createDataFrame(rows, PLAIN), ("y", "order", "one", "turn", "features", "letters", "score", "held_out", "slab", "key", "rank", "_salt", "_gone", "_doc", "gone", "doc", "path", "line", "sig", "raw", "list", "block", "q", "id")
    wide = docs.select("*", *[F.lit(7).alias(c) for c in clash])
    labels = spark.createDataFrame([(0, 1, 1), (3, 0, 0), (1, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))

    def run(frame):
        if name == "language_id":
            from millrace.llm.language_id import predictions

            return predictions(frame)
        if name in ("toxicity", "quality_model"):
            from importlib import import_module

            return import_module(f"millrace.llm.{name}").score(frame, labels, 3, 1)
        if name == "piece_codec":
            from millrace.llm.piece_codec import digest_documents

            return digest_documents(frame, P.path("piece_bpe_32k.model"))
        if name == "packing":
            from millrace.llm.packing import pack

            return pack(frame, P.path("word_bpe_49k.json"))
        if name == "suffix_dedup":
            from millrace.llm.suffix_dedup import cut_repeats

            return cut_repeats(frame, digest=True)
        if name == "line_templates":
            from millrace.llm.line_templates import drop_recurring

            return drop_recurring(frame).select("doc_id", "n_lines", "n_dropped", "text")
        from millrace.llm.vector_search import neighbours

        return neighbours(frame.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.col("doc_id") + 1.0, F.lit(1.0))), F.col("id") >= 0)

    assert run(docs.limit(0)).count() == 0
    plain = sorted(map(str, run(docs).collect()))
    assert plain and sorted(map(str, run(wide).collect())) == plain


def test_null_and_repeated_keys_are_spread(spark):
    from millrace.llm.suffix_dedup import cut_repeats

    passage = "a passage of more than fifty bytes that many of the rows hold, whatever their keys are; "
    rows = [(None if i % 2 else 5, f"{passage}{i} {hashlib.md5(str(i).encode()).hexdigest() * 3}") for i in range(60)] + [(1, passage)]
    got = cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), slab_bytes=2048).collect()
    # Rows with key 5 are covered by key 1 alone; rows without a key share a digit or two behind the passage with rows of key 5 as well.
    assert len(got) == 61 and all(r["n_removed"] == {1: 0, 5: len(passage)}[r["doc_id"]] if r["doc_id"] else 0 <= r["n_removed"] - len(passage) <= 2 for r in got)


@pytest.fixture(scope="module")
def odd(spark):
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = max((b[1] for b in base), key=len)
    more = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, base[3][1], "en", "s", 5), (None, base[3][1], "en", "s", 5), base[5], (9003, (long + " ") * (1_000_000 // len(long)), "en", "s", 1), (9004, "x" * 1_000_000, "en", "s", 1)]
    return spark.createDataFrame(base + more, PLAIN).withColumn("kept", F.lit("x")).withColumn("text_", F.lit(1))


def test_pipeline_stages(spark, odd):
    """Each stage on what the one before kept: its decisions take effect, nothing else is lost, columns stay those of documents."""
    import corpus_pipeline as C

    from millrace.llm.packing import pack
    from millrace.llm.quality_rules import apply_rules
    from millrace.llm.shared import free, settle, standing

    start, docs = standing(), odd
    twice = next(i for i, n in __import__("collections").Counter(r["doc_id"] for r in odd.collect()).items() if n == 2 and i is not None)
    for name, stage in C.STAGES[:-1]:
        rows = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        before, docs = docs, settle(stage(spark, docs, ""), name)
        assert docs.columns == list(C.COLUMNS), name
        kept = {(r["doc_id"], r["text"]) for r in docs.collect()}
        ids = {i for i, _ in rows}
        assert kept and {i for i, _ in kept} <= ids, name
        assert name == "near_dedup" or sum(i == twice for i in (r["doc_id"] for r in docs.collect())) == 2, name
        if name == "quality_rules":
            assert kept == {(r["doc_id"], r["text"]) for r in apply_rules(odd).where("kept").select("doc_id", "text").collect()}
        elif name == "near_dedup":
            assert kept <= rows and all((None, t) in kept for i, t in rows if i is None)
        else:
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        free(before)
        assert len(standing() - start) <= 12, (name, standing() - start)
    out = C.STAGES[-1][1](spark, docs, "")
    assert out.count() == pack(docs, P.path("word_bpe_49k.json"), 2048).count() and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_an_empty_table(spark, odd):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0, name


def test_run_is_its_stages(spark):
    import corpus_pipeline as C

    from millrace.llm.shared import settle

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in C.STAGES:
        docs = settle(stage(spark, docs, ""), name)
    cells = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(C.run(spark, "/root/testdata/sf0.001").select(*cells).collect()) == sorted(docs.select(*cells).collect())


def test_tables_are_dropped(spark):
    """What near_dedup leaves standing is what its result reads."""
    from millrace.llm.near_dedup import classes
    from millrace.llm.shared import drop, standing

    before = standing()
    out = classes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    left = standing() - before
    assert out.count() == 200 and len(left) == 2 and all("whole" in p or "joined" in p for p in left)
    drop(left)
    assert standing() == before
