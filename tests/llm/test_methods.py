"""The operators' methods against plain versions: recall, templates, models, calibration."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n, clusters", [(2_000, 0), (10_000, 0), (50_000, 0), (10_000, 60)])
def test_recall_of_the_scan(spark, n, clusters):
    """The sample, a tenth of the rows at most, gives bounds only: all that is found comes from the scanned lists."""
    from millrace.llm import vector_search as V

    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    if clusters:
        x += 6 * rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    found = defaultdict(list)
    for r in V.neighbours(frame, F.col("id") % 50 == 0).collect():
        found[r["query_id"]].append(r["id"])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, n, 50):
        c = u @ u[q]
        c[q] = -9
        hit += len(set(np.argpartition(-c, 5)[:5].tolist()) & set(found[q]))
    assert all(len(found[q]) == 5 for q in range(0, n, 50)) and hit >= 0.9 * 5 * (n // 50)
    sample = u[rng.permutation(n)[: n // 10]]
    probes = V.Index(sample, n, 5, None, 0.985)
    assert len(sample) <= n // 10 and (not clusters or probes.probes < 0.3 * len(probes.centres))


def test_scan_keeps_what_plain_distances_keep():
    from millrace.llm.vector_search import scan

    rng = np.random.default_rng(4)
    x, q = (rng.normal(size=(m, 40)).astype(np.float32) for m in (3000, 50))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    i, j = scan(x, q, np.full(50, np.inf), 6)
    d = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
    kept = {(a, b) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, int(b)) for a in range(50) for b in np.argsort(d[a])[:6]}
    assert len(want & kept) >= 0.99 * len(want) and len(kept) < 50 * 3000 / 20


def _brute_templates(texts, least):
    """gone lines by document, line by line with dictionaries."""
    lines, keys = {}, defaultdict(set)
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            w = re.findall("[^\x20\x09-\x0d]+", line)
            if w:
                field = [any("0" <= c <= "9" for c in x) for x in w]
                bare = len(w) < 3 and all(field)
                lines[i, k] = [None if f and not bare else x for x, f in zip(w, field)], field
    paths = defaultdict(set)
    for (i, k), (w, _) in lines.items():
        paths[len(w), tuple(w[:3])].add(i)
    slots = Counter()
    for (i, k), (w, field) in lines.items():
        path = len(w), tuple(w[:3])
        if len(paths[path]) >= least:
            slots.update((path, p, x) for p, x in enumerate(w) if p >= 3 and not field[p])
    templates = defaultdict(set)
    for at, (w, field) in lines.items():
        path, own = (len(w), tuple(w[:3])), {("whole", tuple(w))}
        if len(w) >= 6 and not any(field):
            own |= {("open", k, tuple(w[:k] + [None] + w[k + 1 :])) for k in range(3)}
        held = {(p, x): slots[path, p, x] for p, x in enumerate(w) if p >= 3 and not field[p] and slots[path, p, x] >= least}
        for floor in {int(math.log2(n)) for n in held.values()}:
            kept = frozenset(s for s, n in held.items() if int(math.log2(n)) >= floor)
            if 2 * len(kept) >= len(w) - 3:
                own.add(("frequent", path, kept))
        for t in own:
            templates[t].add(at)
    often = {t: at for t, at in templates.items() if len({i for i, _ in at}) >= least}
    holders = {i for at in often.values() for i, _ in at}
    sets, where = {}, defaultdict(list)
    for i in sorted(holders):
        w = re.findall("[^\x20\x09-\x0d]+", texts[i])
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in holders}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g]).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    gone = defaultdict(set)
    for at in often.values():
        if len({find(i) for i, _ in at}) >= least:
            for i, k in at:
                gone[i].add(k)
    return gone


def test_templates_against_dictionaries(spark):
    from millrace.llm.line_templates import recurring_lines

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [(i, t + f"\nshared on the town board by {chr(97 + i % 26)}{i % 7}x {'abcdefg'[i % 7]}y for all readers" * (i % 40 == 0)) for i, t in texts.items()]
    got = {r["doc"]: set(r["gone"]) for r in recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    want = _brute_templates(dict(rows), 10)
    assert len(want) > 50 and got == dict(want)


def test_three_templates(spark):
    """Two variable words side by side, a variable leading word, and a line that copies of one text and other documents share."""
    import random

    from millrace.llm.line_templates import drop_recurring

    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    own = lambda: "\n".join(" ".join(word() for _ in range(20)) for _ in range(3))
    for line in (lambda: f"shared on the town board by {word()} {word()} for all readers today", lambda: f"written by {word()} for all readers of the site today"):
        rows = [(i, f"{own()}\n{line()}") for i in range(20)]
        assert all(x["n_dropped"] == 1 for x in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    copied = own()
    rows = [(i, f"{copied if i < 51 else own()}\na line that is found here and there again") for i in range(100)]
    assert all(x["n_dropped"] == 1 for x in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_line_templates_beyond_the_broadcast(spark, monkeypatch):
    from millrace.llm import line_templates, shared

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r["doc"]: set(r["gone"]) for r in line_templates.recurring_lines(texts, min_docs=3).collect()}
    monkeypatch.setattr(line_templates, "ROWS", -1)
    monkeypatch.setattr(shared, "ROWS", -1)
    assert {r["doc"]: set(r["gone"]) for r in line_templates.recurring_lines(texts, min_docs=3).collect()} == want and want


def test_ftrl_against_a_loop():
    import pyarrow as pa

    from millrace.llm.toxicity import Ftrl, train

    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 64, rng.integers(1, 9))).tolist(), float(rng.random() < 0.4)) for _ in range(200)]
    alpha, beta, l1, l2 = 1.0, 1.0, 0.5, 1e-3
    z, n = [0.0] * 64, [0.0] * 64
    bz = bn = 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    bias = lambda: -bz / ((beta + math.sqrt(bn)) / alpha + l2)
    for _ in range(2):
        for at, y in rows:
            w, b = [weight(i) for i in at], bias()
            g = 1 / (1 + math.exp(-(sum(w) + b))) - y
            for i, v in zip(at, w):
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * v
                n[i] += g * g
            s = (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha
            bz += g - s * b
            bn += g * g
    turns = [(t, y, at) for t in range(3) for at, y in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in turns]), pa.array([t[1] for t in turns]), pa.array([t[2] for t in turns], pa.list_(pa.int32()))], ["turn", "y", "features"])
    (got,) = train(iter([batch]), Ftrl(6, l1=l1), 6, 2)
    got = dict(zip(got.column("place").to_pylist(), got.column("weight").to_pylist()))
    assert all(abs(got.get(i, 0.0) - weight(i)) < 1e-9 for i in range(64)) and abs(got[-1] - bias()) < 1e-9 and abs(got[-3] - np.mean([y for _, y in rows])) < 1e-12


def test_isotonic_against_least_squares():
    from millrace.llm.quality_model import isotonic

    rng = np.random.default_rng(3)
    w = rng.integers(1, 9, 60).astype(float)
    p = np.array([rng.binomial(int(n), min(1, max(0, k / 60 + rng.normal() / 5))) for k, n in enumerate(w)], float)
    got = isotonic(w, p)
    want = [max(min(p[a : b + 1].sum() / w[a : b + 1].sum() for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]  # the max-min formula
    assert np.allclose(got, want) and (np.diff(got) >= -1e-12).all()


def test_quality_scores_against_numpy(spark):
    """Sums over tasks give what one matrix of all rows gives."""
    from millrace.llm.features import statistics
    from millrace.llm.quality_model import BINS, Features, isotonic, score
    from millrace.llm.vec import buffers

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in score(docs.repartition(7), labels, 5, 0).collect()}
    import zlib

    import pyarrow as pa

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    stats = lambda ids: statistics(*buffers(pa.array([texts[i] for i in ids])))
    rows = sorted(set(known) & set(texts))
    x, y = stats(rows), np.array([known[i] for i in rows], float)
    mean = x.mean(0)
    features = Features(mean, np.sqrt(np.maximum((x**2).mean(0) - mean**2, 1e-9)) + 1e-6, 256, 0.05)
    f = features(x)
    beta = np.linalg.solve(f.T @ f + 1e-3 * len(x) / 257 * np.eye(257), f.T @ y)
    bins = lambda raw: np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
    k = bins(f @ beta)
    shares = isotonic(np.bincount(k, minlength=BINS).astype(float), np.bincount(k, weights=y, minlength=BINS))
    every = sorted(texts)
    want = shares[bins(features(stats(every)) @ beta)]
    assert np.mean([abs(got[i] - s) < 1e-6 for i, s in zip(every, want)]) > 0.99


def _fewest(pieces, size):
    """The fewest sequences, by trying all ways."""
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= pieces[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, size - pieces[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    import random

    from millrace.llm.packing import reduce_instance

    r = random.Random(5)
    for _ in range(300):
        size = r.choice([10, 17, 24])
        pieces = sorted((r.randint(1, size) for _ in range(r.randint(1, 10))), reverse=True)
        fixed, left = reduce_instance([pieces.count(n) for n in range(size + 1)], size)
        rest = [n for n in range(size, 0, -1) for _ in range(left[n])]
        assert sorted([n for lengths, many in fixed for n in lengths * many] + rest, reverse=True) == pieces
        assert sum(many for _, many in fixed) + _fewest(rest, size) == _fewest(pieces, size)


def test_reduction_goes_on_behind_a_piece_that_stays():
    from millrace.llm.packing import reduce_instance

    counts = [0] * 101
    for n in (60, 20, 15, 15, 10, 58, 41):  # beside 60 three pieces fit that sum to more than 20; beside 58 nothing is fuller than 41
        counts[n] += 1
    fixed, left = reduce_instance(counts, 100)
    assert ((58, 41), 1) in fixed and left[60] == 1
