"""Kernels against plain versions, without Spark."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import bwt, language_id, near_dedup, packing, toxicity, vec
from millrace.llm.quality_model import isotonic

P = pytest.importorskip("public_tokenizers")


def texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r", "é", "▁", "日", "😀", "́", "the", " the", "ing", "0", "12", ".", "!", "\x00", "    ", "Ünd", "ß", "<s>", "<unk>", "<|endoftext|>", "Σ", "İ", "\x1c", "\x85", "don't", "I'LL", "²", "｡"]
    return ["", " ", "  a", "a  "] + ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(n)]


def test_codec_equals_library():
    import sentencepiece

    from millrace.llm.piece_codec import PieceCodec

    own, lib = PieceCodec(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in [*texts(1, 1500), *[" " * n for n in range(40)], *["a" * n for n in range(40)]]:
        ids, decoded = own.encode_spelled(t)
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded.decode() == lib.decode(want) == own.decode(want)


def test_word_ids_equal_library():
    own = packing.WordTokens(P.path("word_bpe_49k.json"))
    for t in texts(2, 1500):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == own.lib.encode(t, add_special_tokens=False).ids, t


def test_every_token_encodes_to_itself():
    """Why ranks may stand for the list of merges: no token is spelled by another pair first."""
    import json

    model = json.load(open(P.path("word_bpe_49k.json")))["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    for token in list(model["vocab"])[:: 7]:
        if token.startswith("<|"):
            continue
        parts = list(token[:-4] if token.endswith("</w>") and len(token) > 4 else token)
        if token.endswith("</w>") and len(token) > 4:
            parts[-1] += "</w>"
        while (best := min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)) is not None:
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert parts == [token]


@pytest.mark.parametrize("size", [7, 16, 100])
def test_plan_places_each_piece_once(size):
    r = random.Random(size)
    for _ in range(150):
        counts = [0] * (size + 1)
        for _ in range(r.randrange(60)):
            counts[r.randrange(1, size + 1)] += 1
        bins, seen = defaultdict(list), set()
        for n, rank, many, sequence, offset in packing.plan(counts, size).tolist():
            for k in range(many):
                bins[sequence + k].append((offset, n))
                seen.add((n, rank + k))
        assert seen == {(n, k) for n in range(size + 1) for k in range(counts[n])}
        for found in bins.values():
            end = 0
            for offset, n in sorted(found):
                assert offset == end
                end += n
            assert end <= size


def test_reduction_keeps_the_optimum():
    def optimum(items, size):
        best = [len(items)]

        def put(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
                put(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
            put(k + 1, [*rooms, size - items[k]])

        put(0, [])
        return best[0]

    r = random.Random(4)
    for _ in range(60):
        items = sorted((r.randrange(1, 13) for _ in range(r.randrange(1, 9))), reverse=True)
        counts = [items.count(n) for n in range(13)]
        fixed, left = packing.reduce_instance(counts, 12)
        rest = [n for n in range(12, 0, -1) for _ in range(left[n])]
        assert sum(k for _, k in fixed) + (optimum(rest, 12) if rest else 0) == optimum(items, 12)


def test_equal_windows():
    r = random.Random(5)
    for _ in range(200):
        least = r.choice([1, 2, 3, 5, 8])
        t = "".join("".join(r.choice("abc"[: r.choice([2, 3])]) for _ in range(r.randrange(30))) + "\0" for _ in range(r.randrange(1, 8)))
        order, group = bwt.equal_windows(np.frombuffer(t.encode(), np.uint8), least)
        want, got = defaultdict(set), defaultdict(set)
        for k, s in enumerate(order.tolist()):
            window = t[s : s + least]
            if len(window) == least and "\0" not in window:
                want[window].add(s)
                got[int(group[k])].add(s)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_viterbi():
    rng = np.random.default_rng(1)
    for states in (2, 3, 9):
        for _ in range(20):
            sizes = rng.integers(1, 5, size=4)
            s, b = np.round(rng.normal(size=(sizes.sum(), states)) * 3, 1), np.concatenate([[0], np.cumsum(sizes)])
            found = language_id._paths(s, [(int(x), int(y)) for x, y in zip(b, b[1:])], 2.0)
            for k, path in enumerate(found):
                own = s[b[k] : b[k + 1]]
                value = lambda p: sum(own[t, p[t]] for t in range(len(own))) - 2.0 * sum(p[t] != p[t - 1] for t in range(1, len(own)))  # noqa: B023, E731
                assert abs(value(path) - max(map(value, itertools.product(range(states), repeat=len(own))))) < 1e-9


def test_words_and_shingles():
    docs = ["A b\tc  d\x0be f", "", "one", "x y z w", " \n", "é\x0cß ✓"]
    raw = [d.encode() for d in docs]
    data, off = vec.LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([0, *map(len, raw)])
    starts, ends, bounds = vec.word_spans(data, off)
    assert np.diff(bounds).tolist() == [6, 0, 1, 4, 0, 3]
    sets = near_dedup.document_sets(np.frombuffer(b"".join(raw), np.uint8), off, 5)
    assert [len(s) for s in sets] == [2, 0, 1, 1, 0, 1]
    assert (near_dedup.document_sets(np.frombuffer(b"a B c d e", np.uint8), np.array([0, 9]), 5)[0] == near_dedup.document_sets(np.frombuffer(b"A b  c\nd e", np.uint8), np.array([0, 10]), 5)[0]).all()


def test_bayes_keeps_alike_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, (300, near_dedup.HASHES), dtype=np.uint32)
    other = np.where(rng.random(base.shape) < 0.88, base, base + 1)
    assert len(near_dedup.survivors(base, other.astype(np.uint32), 0.85, 1e-7)) == 300
    assert len(near_dedup.survivors(base, base[::-1].copy(), 0.85, 1e-7)) == 0


def test_isotonic():
    got = isotonic(np.array([2, 0, 2, 4, 1]), np.array([1, 0, 0, 4, 0]))
    assert (np.diff(got) >= 0).all() and got[0] == 0.25 and got[-1] == 0.8


def test_ftrl_is_sparse_and_learns():
    model = toxicity.Ftrl(8, l1=1.0)
    for k in range(400):
        y = k % 2
        model.learn(np.array([1 + y, 10 + k % 100]), float(y))
    w = model.weights(np.arange(256))
    assert w[2] > 1 > -1 > w[1] and (w != 0).sum() < 40
