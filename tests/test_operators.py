import json
import re
from dataclasses import replace

from pyspark.sql import functions as F

from millrace.functions.profiles import Build, Pairs, Quality
from millrace.operators import corpus, gates, glue, metrics, near, packing, pairs, prompts
from millrace.sources import readers, writers

OPEN = Build(language=None, machine_translation=False, quality=Quality(least_chars=0, least_words=0, least_letters=0, least_distinct_lines=0, word_length=(0, 99)))


def test_quality_boundaries(spark):
    def reason(text):
        return spark.createDataFrame([(0, 0, "s", text)], "priority int, doc_ord long, source string, text string").transform(lambda d: corpus.gated(d, Build(language=None))).first()["reason"]

    good = " ".join(["abcde"] * 40)
    assert reason(good) is None
    assert reason(good[:199]) == "too short"
    assert reason("abcdefghij " * 19) == "too few words"
    assert reason("a " * 150) == "word length"
    assert reason("ab 1234 " * 40) == "not enough letters"
    assert reason("\n".join([good] * 4)) == "repeated lines"
    assert reason(good + " #" * 5) == "symbols"
    assert reason(good + " google translated") == "machine translated"
    assert reason("") == "too short"


def test_build_keeps_first(spark):
    long = ["".join(chr(97 + (i * 7 + j) % 26) for j in range(80)) for i in range(8)]
    rows = [
        (1, 10, "src1", "\n".join(long[:4])),
        (0, 20, "src0", "\n".join([long[0], "short", *long[4:6], "short"])),
        (1, 11, "src1", "\n".join(long[:4])),
        (2, 12, "src2", "\n".join(long[:3])),
        (2, 13, "src2", "\n".join([long[2], *long[6:], long[6]])),
    ]
    docs = spark.createDataFrame(rows, "priority int, doc_ord long, source string, text string")
    got = {r["doc_ord"]: r for r in corpus.build(docs, replace(OPEN, least_fresh=100)).collect()}
    assert got[20]["text"] == rows[1][3] and not got[20]["partly_duplicate"]
    assert got[10]["text"] == "\n".join(long[1:4]) and got[10]["partly_duplicate"]
    assert got[11]["reason_detail"] == "copy" and got[12]["reason_detail"] == "little fresh text"
    assert got[13]["text"] == "\n".join(long[6:])
    counts = {(r["source"], r["reason"]): r["n"] for r in corpus.source_counts(corpus.build(docs, replace(OPEN, least_fresh=100))).collect()}
    assert counts["src2", "read"] == 2 and counts["src2", "duplicate"] == 1 and counts["src2", "kept"] == 1


def test_near_resolution(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {r["doc_id"]: r["kept"] for r in near.resolve(chain).collect()}
    assert got == {2: False, 3: True, 4: False}
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(8)) + [20]), (3, list(range(9))), (4, [99])], "doc_id long, shingles array<long>")
    assert {(r["a"], r["b"]) for r in near.near_pairs(sets, 0.8).collect()} == {(1, 3)} | {(2, 3)} - {(2, 3)}
    assert {(r["a"], r["b"]) for r in near.near_pairs(sets, 0.7).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_pack_blocks(spark):
    rows = [(i, "train", [i] * i + [0]) for i in range(1, 9)] + [(9, "val", [5, 0])]
    got = {(r["split"], r["block_id"]): r["ids"] for r in packing.blocks(spark.createDataFrame(rows, "doc_id long, split string, ids array<int>"), 7, 3).collect()}
    stream = [x for _, s, ids in rows if s == "train" for x in ids]
    assert got == {("train", k): stream[7 * k : 7 * k + 7] for k in range(len(stream) // 7)}


def test_count_split(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    assert packing.count_split(docs, 0.05).where("split = 'val'").count() == 2
    assert packing.count_split(docs.limit(1), 0.05).where("split = 'val'").count() == 1


def test_pair_reasons(spark):
    def reason(i, r, p=Pairs()):
        return pairs.rejected(spark.createDataFrame([(i, r)], "instruction string, response string"), p).first()["reason"]

    target = "yo nan pou ak se li ki gen pa mwen nou te ap sa yon lan"
    assert reason("x" * 9, target) == "instruction length"
    assert reason("x" * 10, "y" * 39) == "response length"
    assert reason("nan pou ak se", "Voici " + target) == "teacher commentary"
    assert reason("nan pou ak se", "Dakò, " + target) is None
    assert reason("nan pou ak se", target + " zzz") is None
    assert reason("english words here", "english words that are not in the list of target words at all") == "not kreyol enough"
    assert reason("nan pou ak se", target + " les des est une dans") == "french"
    assert reason("1234567890", "1" * 40) == "not kreyol enough"


def test_parse(spark):
    rows = [(1, 'see [{"enstriksyon": " a ", "repons": 5}, 3] end'), (2, "[bad"), (3, '[{"enstriksyon": "", "repons": "x"}]')]
    got = [(r["id"], r["instruction"], r["response"]) for r in pairs.parsed(spark.createDataFrame(rows, "id long, reply string")).collect()]
    assert got == [(1, "a", "5")]


def test_report_median_is_upper(spark):
    rows = [("a", "x" * n) for n in (1, 2, 3, 4)]
    assert pairs.report(spark.createDataFrame(rows, "instruction string, response string")).first()["median_response_chars"] == 3


def test_generate(spark):
    def ask(prompt):
        if "pou yon granmoun" in prompt:
            raise OSError
        return json.dumps([{"enstriksyon": f"{abs(hash(prompt))} kesyon {i}", "repons": "nou te ap sa yon lan la men epi sou tout " * 2} for i in range(4)])

    made, dropped = prompts.generate(spark, ask, target=20, per_call=4, p=Pairs(floor=None, ceiling=None))
    assert made.count() == 20 and set(dropped) <= {"call failed"}
    assert prompts.wave_size(0, 0, 100, 10, 30) == 15


def test_glue(spark):
    rows = [("s", i, "x" * 900) for i in range(5)] + [("t", 9, " y ")]
    got = {(r["source"], r["doc_ord"]): r["text"] for r in glue.glued(spark.createDataFrame(rows, "source string, doc_id long, text string")).collect()}
    assert {k: len(v) for k, v in got.items()} == {("s", 0): 2702, ("s", 1): 1801, ("t", 0): 1}


def test_position_profile(spark):
    rows = [(i, [0.0, 1.0 if i < 32 else 0.1 + i * 1e-6, -0.5]) for i in range(160)]
    got = metrics.position_profile(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", init=0.32).first()
    assert got["rows"] == 160 and got["trained"] == 32


def test_round_trip_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(10)], "n long, text string, source string")
    writers.shards(docs, str(tmp_path / "out"), 3, "n", parts=2)
    assert readers.json_lines(spark, str(tmp_path / "out")).count() == 10
    (tmp_path / "bad.jsonl").write_text('{"text": "a", "source": "x"}\nnot json\n{"source": "y"}\n')
    assert sorted(r["text"] for r in readers.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()) == ["", "a"]
    blocks = spark.createDataFrame([("train", 0, [1, 65_535]), ("train", 1, [3, 4])], "split string, block_id long, ids array<int>")
    writers.token_blocks(blocks, str(tmp_path / "bins"))
    assert {r["block_id"]: bytes(r["data"]) for r in spark.read.parquet(str(tmp_path / "bins")).collect()} == {0: b"\x01\x00\xff\xff", 1: b"\x03\x00\x04\x00"}
    (tmp_path / "flat.bin").write_bytes(bytes(range(10)))
    assert [r["ids"] for r in readers.token_blocks(spark, str(tmp_path / "flat.bin"), 2).collect()] == [[256, 770], [1284, 1798]]
    raw = spark.createDataFrame([(None, "b"), ("", None), ("a", "c")], "text string, content string")
    assert sorted(r["text"] for r in readers.raw_rows(raw).collect()) == ["a", "b"]


def test_gate_order(spark):
    got = spark.range(1).select(gates.first_reason((F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c")).alias("x")).first()[0]
    assert got == "b"


def test_flat_token_files(spark, tmp_path):
    rows = [(split, k, [k, 65_535 - k, n]) for n, split in enumerate(("train", "val")) for k in range(20)]
    told = writers.token_files(spark.createDataFrame(rows, "split string, block_id long, ids array<int>").repartition(5), str(tmp_path / "flat"), 3)
    assert sum(r["blocks"] for r in told.collect()) == 40
    for n, split in enumerate(("train", "val")):
        files = sorted((tmp_path / "flat" / split).glob("[0-9]*.bin"))
        whole = b"".join(f.read_bytes() for f in files)
        assert whole == b"".join(x.to_bytes(2, "little") for k in range(20) for x in (k, 65_535 - k, n))
        assert sorted(r["ids"] for r in readers.token_blocks(spark, f"{tmp_path}/flat/{split}/*.bin", 3).collect()) == sorted(r[2] for r in rows if r[0] == split)


def test_manifest_needs_a_block(spark):
    import pytest

    rows = spark.createDataFrame([("train", 300), ("val", 100)], "split string, n_tokens long")
    assert {r["split"]: r["blocks"] for r in packing.manifest(rows, 100).collect()} == {"train": 3, "val": 1}
    with pytest.raises(Exception, match="less than one block"):
        packing.manifest(rows, 200).collect()


def test_mixed_files_number_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one text\nof two lines")
    (tmp_path / "b.json").write_text('[{"text": "x"}, "plain", {"other": 1}]')
    (tmp_path / "c.jsonl").write_text('{"text": "first"}\n{"text": "second"}\n')
    got = {r["name"]: r["text"] for r in readers.mixed_files(spark, [str(tmp_path / "*.txt")], [str(tmp_path / "*.json")], [str(tmp_path / "*.jsonl")]).collect()}
    assert got == {"a.txt": "one text\nof two lines", "b.json#0": "x", "b.json#1": "plain", "b.json#2": "", "c.jsonl#0": "first", "c.jsonl#1": "second"}


def test_shards_and_strict_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}") for i in range(9)] + [(9, "", "s0")], "n long, text string, source string")
    assert writers.shards(docs, str(tmp_path / "out"), 4, "n", parts=1) == {"documents": 10, "characters": 54}
    for k, f in enumerate(sorted((tmp_path / "out").glob("*.json.gz"))):
        f.rename(tmp_path / "out" / f"shard-{k:04d}.jsonl.gz")
    assert sorted(r["text"] for r in readers.shards(spark, str(tmp_path / "out"), ("s1",)).collect()) == [f"text {i}" for i in range(9) if i % 3 != 1]
    made = spark.createDataFrame([(i, f"kesyon {i}", "répons") for i in range(5)], "n long, instruction string, response string")
    writers.pairs(made, str(tmp_path / "sft"), 3, "n")
    lines = [json.loads(x) for f in (tmp_path / "sft").glob("*.json") for x in f.read_text("utf-8").splitlines()]
    assert [x["instruction"] for x in lines] == ["kesyon 0", "kesyon 1", "kesyon 2"] and "répons" in next((tmp_path / "sft").glob("*.json")).read_text("utf-8")
    writers.one_json(made.agg(F.count("n").alias("pairs")), str(tmp_path / "one"))
    assert [json.loads(f.read_text()) for f in (tmp_path / "one").glob("*.json")] == [{"pairs": 5}]
    import pytest

    (tmp_path / "bad.jsonl").write_text('{"enstriksyon": "a", "repons": "b"}\nnot json\n')
    with pytest.raises(Exception):
        readers.strict_pairs(spark, str(tmp_path / "bad.jsonl")).collect()


def test_head_and_published(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}") for i in range(10)], "n long, source string")
    assert sorted(r["n"] for r in readers.head(rows, 3, "n").collect()) == [0, 1, 2] and readers.head(rows, 0, "n").count() == 10
    assert sorted(r["n"] for r in readers.head(rows, 2, "n", by="source").collect()) == [0, 1, 2, 3]
    lost = readers.published(spark.createDataFrame([("comparison", "not json")], "name string, text string")).first()
    assert lost["ratio"] is None and lost["parameters"] is None


def test_composition(spark):
    import unicodedata

    from millrace.functions import udfs

    odd = ["e\u0301", "\u1100\u1161\u11a8", "a\u0323\u0302", "\u212b", "\u0958", "\u09c7\u09be", "plain", "", "\U0001d15e", "q\u0307\u0323", "\u0344"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").coalesce(1).select(udfs.composed(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in odd]
    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", udfs._may_change()))
    assert all(pattern.search(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c))


def test_hashes_and_bpe_against_libraries(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.functions import udfs
    from millrace.operators import tokenizer

    texts = [(i, t) for i, t in enumerate(["", "Ayiti se yon peyi", "kòm\n\n  de"])]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r[0]: r[1] for r in frame.select("doc_id", udfs.blake2b_32("text")).collect()} == {i: int(hashlib.blake2b(t.encode(), digest_size=4).hexdigest(), 16) for i, t in texts}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["ids"] for r in tokenizer.encoded(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in texts}


def test_glue_repeated_rows(spark):
    rows = [("s", 1, "x" * 1500), ("s", 1, "x" * 1500), ("s", 1, "y"), ("s", 2, "z" * 10)]
    got = sorted((r["doc_ord"], r["text"]) for r in glue.glued(spark.createDataFrame(rows, "source string, doc_id long, text string")).collect())
    assert sorted("\n".join(t for _, t in got).split("\n")) == sorted(r[2] for r in rows)


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from millrace.sources import stage

    class Conf(dict):
        set = dict.__setitem__

    def session(master, conf):
        context = SimpleNamespace(master=master, getConf=lambda: Conf())
        return SimpleNamespace(sparkContext=context, conf=Conf(conf))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stage.shared_dir(session(master, {}))
        assert stage.shared_dir(session(master, {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert stage.shared_dir(session("local[4]", {})).startswith("file:///")


def test_tables_are_dropped_once(spark):
    from millrace.sources import stage

    before = stage.standing()
    one, two = stage.settle(spark.range(5), "one"), stage.settle(spark.range(7), "two")
    assert len(stage.standing() - before) == 2 and two.count() == 7
    stage.free(one)
    stage.free(one)
    assert len(stage.standing() - before) == 1 and two.count() == 7
    stage.free(two)
    assert stage.standing() == before


def test_window_without_texts(spark):
    import math

    rows = [("a", 0, 64, 2.0), ("a", 0, 100, 4.0), ("a", 600, 663, 9.0)]
    got = {r["start"]: (r["loss"], r["texts"]) for r in metrics.window_losses(spark.createDataFrame(rows, "model string, start int, tokens long, loss double"), (0, 600), 64, "model").collect()}
    assert got[0] == (3.0, 2) and math.isnan(got[600][0]) and got[600][1] == 0


def test_long_texts_are_encoded_in_pieces(spark):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.operators import tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(file)
    odd = ["", "x" * 500, "a b", " a  b \n c\u00a0d\x1c e \x85 f's 't 12 3 <|endoftext|> !? g", "the quick fox, " * 40, "\u0939\u093f \u0928 \U0001f600 z " * 20, None]
    assert [x for x in odd if x and "".join(tokenizer.chunks(x, 3)) != x] == []
    for t in filter(None, odd):
        assert [i for x in tokenizer.chunks(t, 3) for i in lib.encode(x, add_special_tokens=False).ids] == lib.encode(t, add_special_tokens=False).ids
    solve, draw = tokenizer.ids_of(file), random.Random(3)
    parts = ["  ", "\n", "a", "the", "ing", "'re", "1", "...", "\u00e9", "\u00a0", "\x85", "\x1c", "<|endoftext|>", "\u4e2d", "\u0301", "\U0001f600", " "]
    made = ["".join(draw.choices(parts, k=12)) for _ in range(2000)] + ["".join(draw.choices("etaoinshrd", k=20)) for _ in range(2000)]
    assert all(list(solve(t)) == lib.encode(t, add_special_tokens=False).ids for t in [*filter(None, odd), *made, *(f"a{u}b {u}1 {u}{u}" for u in map(chr, range(0x3000)))])
    assert "numpy" in type(solve("a")).__module__
    assert max(map(len, tokenizer.chunks("the quick fox, " * 100_000))) < tokenizer.CHUNK + 100
    rows = spark.createDataFrame([(k % 3, t, k) for k, t in enumerate(odd)], "doc_id long, text string, n int")
    got = {r["n"]: (r["doc_id"], r["ids"]) for r in tokenizer.encoded(rows, file, end_id=None, carry=("n",)).collect()}
    assert got == {k: (k % 3, lib.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(odd)}


def test_encoding_holds_few_texts_at_once():
    import pyarrow as pa

    from millrace.operators import tokenizer

    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "x" * 3_000_000, *["y" * 1_000_000] * 5, ""], pa.string())})
    parts = list(tokenizer.slices(batch, "text"))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and [p.num_rows for p in parts] == [1, 1, 2, 2, 2]


def test_fertility_counts_each_row_once(spark, tmp_path):
    from millrace.plans import catalogue

    rows = [(1, "yon ti peyi"), (1, "yon ti peyi"), (None, "de"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert catalogue.bpe_fertility(spark, str(tmp_path)).first()["documents"] == 4
