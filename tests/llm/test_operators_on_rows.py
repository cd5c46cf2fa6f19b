"""Operators on small frames: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, kept string, score double, key string"


@pytest.fixture(scope="module")
def docs(spark):
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    one = max((b[1] for b in base if 400 < len(b[1]) < 4000), key=len)
    words = one.split(" ")
    words[len(words) // 2] = "changed"
    more = [(1001, None, None, None), (1002, "", "en", None), (1003, " \n\t", "en", "s"), (1004, one, None, "s"), (1005, " ".join(words), "en", "s"), (1006, "a " * 60_000, "en", "s"), (1007, "x" * 300_000, "en", "s"), (1008, "ab\x00cd\x00" * 30, "en", "s"), (1009, "12 34 !!", "en", "s"), (1010, "one", "en", "s"), (1011, "ONE", "en", "s")]
    rows = [(*b, None, 1, "x", 0.5, "k") for b in base + more]
    return spark.createDataFrame([*rows, rows[0], rows[-1]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_quality_rules(docs, texts):
    from millrace.llm.quality_rules import apply_rules

    got = apply_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        w = re.findall("[^\x20\x09-\x0d]+", texts[r["doc_id"]])
        grams = list(zip(w, w[1:], w[2:]))
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(covered), sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert apply_rules(docs.limit(0)).count() == 0


def test_near_dedup(docs, texts):
    from millrace.llm.near_dedup import classes

    lower = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for i, t in texts.items()}
    sets = {}
    for i, t in lower.items():
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = classes(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert classes(docs.limit(0)).count() == 0


def test_near_dedup_parts_of_a_bucket(spark):
    """Texts that share buckets but hang together through a third only."""
    import random

    from millrace.llm.near_dedup import classes

    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for k in r.sample(range(200), r.choice([1, 2, 3, 4, 6])):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {x["doc_id"]: x["component_id"] for x in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: find(i) for i in sets}


def test_near_dedup_stage_takes_four_fifths(spark):
    import random

    import corpus_pipeline

    from millrace.llm.near_dedup import HASHES, shape

    r = random.Random(17)
    texts = []
    for _ in range(20):
        base = [f"w{r.randrange(10**6)}" for _ in range(204)]
        for changed in ((), (20, 60, 100, 140), (20, 60, 100, 140, 180)):  # similarity 0.82 and 0.78 to the first
            texts.append(" ".join(f"v{r.randrange(10**6)}" if k in changed else w for k, w in enumerate(base)))
    pairs = [t for i, t in enumerate(texts) if i % 3 < 2]
    far = [t for i, t in enumerate(texts) if i % 3 != 1]
    for chosen, left in ((pairs, 20), (far, 40)):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(chosen)], "doc_id long, text string, lang string, source string, n_chars long")
        assert corpus_pipeline.near_dedup(spark, frame, "").count() == left
    assert shape(85) == (25, 5)
    for percent in (50, 80, 85, 95):
        bands, rows = shape(percent)
        assert bands * rows <= HASHES and (1 - (percent / 100) ** rows) ** bands <= 5e-7


def test_near_dedup_stage_keeps_rows_without_id(spark):
    import corpus_pipeline

    rows = [(i, "one text of a few words that is here more than once", "en", "s", 51) for i in (4, 3, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert [x["doc_id"] for x in got if x["doc_id"] is not None] == [3] and len(got) == 3 and all(x["text"] == rows[0][1] for x in got)


def test_suffix_dedup(docs, texts):
    from millrace.llm.suffix_dedup import cut_repeats

    first, want = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = cut_repeats(docs, digest=True, slab_bytes=1 << 17).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    assert cut_repeats(docs.limit(0)).count() == 0


def test_packing(docs, texts):
    from millrace.llm.packing import pack
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = pack(docs, P.path("word_bpe_49k.json"), 512).collect()
    bins, by_doc = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
    for found in bins.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 512
    for i, t in texts.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert len(by_doc[i]) == -(-len(ids) // 512)
        for k, r in by_doc[i].items():
            part = ids[512 * k : 512 * (k + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (512 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_codec_frame(docs, texts):
    import sentencepiece

    from millrace.llm.piece_codec import digest_documents

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in digest_documents(docs, P.path("piece_bpe_32k.model")).collect():
        if len(texts[r["doc_id"]]) < 200_000:
            ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_line_templates(spark):
    from millrace.llm.line_templates import drop_recurring

    own = [f"Line {chr(97 + i)} of a document that no other document holds, number {'abcdefghijklmnop'[i]}{i}." for i in range(16)]
    rows = [(i, f"{own[i]} alpha{i}x beta\nPage {i} of 200 in this archive\nshared by people of {'red blue green'.split()[i % 3]} town hall in summer\n\n{own[i][::-1]}") for i in range(12)]
    rows += [(100 + i, "a copied document with its own line\nand another line of it here") for i in range(30)] + [(200, None), (201, ""), (None, "Page 3 of 200 in this archive")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone string").withColumn("n_lines", F.lit(7))
    got = {r["doc_id"]: r for r in drop_recurring(frame, min_docs=10).collect()}
    assert len(got) == len(rows)
    assert all("Page" not in got[i]["text"] and "shared by" not in got[i]["text"] and own[i] in got[i]["text"] for i in range(12))
    assert all(got[100 + i]["n_dropped"] == 0 for i in range(30))
    assert got[200]["text"] is None and got[201]["text"] == "" and "Page" in got[None]["text"]


def _edited(r, name, n_lines, n_words, copies, edits):
    """Texts of a base and of copies of it with `edits` words changed in each."""
    base = [[f"{name}{chr(97 + i % 26)}{''.join(r.choices('abcdefgh', k=6))}" for i in range(n_words)] for _ in range(n_lines)]
    out = ["\n".join(map(" ".join, base))]
    for _ in range(copies):
        lines = [list(x) for x in base]
        for k in r.sample(range(n_lines * n_words), edits):
            lines[k // n_words][k % n_words] = "".join(r.choices("stuvwxyz", k=9))
        out.append("\n".join(map(" ".join, lines)))
    return out


def test_line_templates_leave_edited_copies(spark):
    import random

    from millrace.llm.line_templates import drop_recurring

    r = random.Random(5)
    shapes = [(6, 25, 1), (6, 25, 2), (20, 12, 3), (1, 150, 1)]
    texts = [t for g, (lines, words, edits) in enumerate(shapes * 2) for t in _edited(r, "klmnopqr"[g], lines, words, 60, edits)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = drop_recurring(frame).collect()
    assert len(got) == len(texts) and all(x["n_dropped"] == 0 and x["text"] == texts[x["doc_id"]] for x in got)


def test_line_templates_shared_with_copies(spark):
    import random

    from millrace.llm.line_templates import drop_recurring

    r = random.Random(9)
    said = "subscribe to the weekly letter of this fine paper"
    own = [t + "\n" + said for i in range(12) for t in _edited(r, f"o{chr(97 + i)}", 3, 20, 0, 0)]
    copies = [t + "\n" + said for t in _edited(r, "copied", 3, 20, 40, 1)]
    got = {x["doc_id"]: x for x in drop_recurring(spark.createDataFrame(list(enumerate(own + copies)), "doc_id long, text string")).collect()}
    assert all((x["n_dropped"], said in x["text"]) == (1, False) for x in got.values()) and len(got) == 53


def test_line_templates_of_short_lines(spark):
    import random

    from millrace.llm.line_templates import drop_recurring

    r = random.Random(11)
    texts = [f"Menu\n{t}\nPage {i}\n\u6240\u6709\u6743\u5229\n\u7b2c{i}\u7ae0\u3002\n{1000 + i}\nNext page" for i in range(12) for t in _edited(r, f"s{chr(97 + i)}", 3, 20, 0, 0)]
    for x in drop_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        lines = texts[x["doc_id"]].split("\n")
        assert x["text"].split("\n") == lines[1:4] + lines[6:8] and x["n_dropped"] == 4


def test_line_templates_with_variable_words(spark):
    import random

    from millrace.llm.line_templates import drop_recurring

    r = random.Random(13)
    name = lambda k: "".join(r.choices("bcdfg", k=k)).title()
    first, last = [[name(n) for _ in range(12)] for n in (7, 8)]
    texts = []
    for i in range(144):
        own = _edited(r, f"v{chr(97 + i % 26)}{chr(97 + i // 26)}", 2, 20, 0, 0)[0]
        short = [f"Posted here today by {name(9)} for readers"] if i < 12 else []
        both = [f"The very same beginning {name(9)} {name(9)} {name(9)} {name(9)}"]
        texts.append("\n".join([own, *short, f"Please write to office manager {first[i % 12]} {last[i // 12]} for further details", f"Brought to you by {name(9)} and his {name(9)} friends", *both]))
    for x in drop_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        lines = texts[x["doc_id"]].split("\n")
        assert x["text"].split("\n") == [*lines[:2], lines[-1]]


def test_language(spark, docs):
    from millrace.llm.language_id import identify, predictions

    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = predictions(train).join(train.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r for r in identify(docs, F.lit(True)).collect()}
    assert [odd[i]["lang_pred"] for i in (1001, 1002, 1003, 1009)] == ["und"] * 4 and odd[1010]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}


@pytest.mark.parametrize("name, modulus, remainder", [("toxicity", 3, 1), ("quality_model", 5, 0)])
def test_scores(spark, docs, name, modulus, remainder):
    from importlib import import_module

    score = import_module(f"millrace.llm.{name}").score
    label = {"toxicity": "toxic", "quality_model": "quality"}[name]
    train, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = train.join(labels, "doc_id").select("doc_id", "text").where("doc_id < 6000")
    got = score(some, labels, modulus, remainder).join(labels, "doc_id").collect()
    held = [(r[label], r["predicted"]) for r in got if r["held_out"]]
    hit = sum(y == p == 1 for y, p in held)
    assert hit / max(1, sum(p for _, p in held)) > 0.85 and hit / sum(y for y, _ in held) > 0.55
    for frame, known in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        out = score(frame, known, modulus, remainder).collect()
        assert len(out) == frame.count() and all(math.isfinite(r["score"]) and 0 <= r["score"] <= 1 for r in out)


def test_vector_search(spark):
    from millrace.llm.vector_search import neighbours

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[1000:1100] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24), (5200, [1.0]), (None, x[3].tolist())]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("id") % 50 == 0, sample=500).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        c = np.round(u @ u[q], 12)
        c[q] = -9
        want = np.lexsort((np.arange(3000), -c))[:5]
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
        hit += len(set(want.tolist()) & {i for i, _ in found[q].values()})
    assert set(found) == set(range(0, 3000, 50)) and hit >= 0.9 * 300
    assert [found[1000][k][0] for k in range(1, 6)] == [7, 1001, 1002, 1003, 1004]
    assert neighbours(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).count() == 3
    assert neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).count() == 0
