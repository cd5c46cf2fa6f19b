"""Removing long passages that repeat across documents, by bounded interval expansion on Burrows-Wheeler transforms.

A byte is removed if a string of `least` bytes over it also starts in a document with a smaller key. One transform of a whole corpus is no task
for one machine, so equal windows are first brought together:

1. Documents are dealt into slabs of a few megabytes by a hash of their key and text. Every window of `least` bytes has an anchor, the smallest hash of the
   `gram`-byte strings in it; equal windows have equal anchors. A run of window starts with one anchor is a span, and its text is kept whole.
2. Each slab sends its anchors, once each and as 32 bits beside their part, to the part that owns them; a part answers which of them other slabs
   have too. This leaves only text that may repeat; a chance match of hashes costs work and changes nothing.
3. Each slab sends the distinct span texts of those anchors, with the smallest key that carries each, to one of FAN parts of the anchor's part. It lays texts
   that share an anchor out one after another, builds the suffix order and the transform, and expands intervals up to `least`: windows of one interval are equal. Each gets
   the smallest key of all its carriers.
4. Parts answer with ranges of windows and that key; slabs mark the bytes of their documents with larger keys, and cut.

What crosses the network is a block for each slab and part that have anchors in common, so never more blocks than anchors, whatever the number of slabs; a
passage that a third of all documents hold is sent once by each slab. Parts cut their work into sub-parts of about `batch` bytes, whole anchors together. All four steps read the same dealt documents.

Defined cases: null texts count as empty; texts shorter than a window lose nothing; rows with the same key do not cover each other; rows with a null
key count as larger than all and cover nothing; a very long text is worked on whole, with about 30 bytes of memory for each of its own; an empty table gives an empty result; columns other
than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bwt import equal_windows
from millrace.llm.shared import input_bytes
from millrace.llm.vec import BASE, BYTE_VALUES, buffers, mix, powers

NO_KEY = np.iinfo(np.int64).max
INVERSE = pow(int(BASE), -1, 2**64)
#: Powers are tabled for so many places, and multiplied by one number for each stretch of that length.
STRETCH = 1 << 18
#: Parts of spans in a part of anchors: anchors are 4 bytes in 18 of text, spans are whole texts.
FAN = 16


@cache
def _inverses() -> np.ndarray:
    out = np.full(STRETCH, INVERSE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Slab:
    """Documents of one slab in order of key and text, with the spans of their windows."""

    def __init__(self, rows: pa.Table, least: int, gram: int):
        keys = rows.column("key").to_numpy(zero_copy_only=False) if not rows.column("key").null_count else np.array([NO_KEY if k is None else k for k in rows.column("key").to_pylist()], np.int64)
        texts = rows.column("text").fill_null("")
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i].as_py())) if len(np.unique(keys)) < len(keys) else np.argsort(keys, kind="stable")
        self.order = pa.array(order, pa.int64())
        self.keys, self.nulls = keys[order].astype(np.int64), np.array(rows.column("key").is_null())[order]
        self.data, self.off = buffers(texts.take(self.order))
        self.least = least
        n = len(self.data)
        self.starts = self.sizes = self.docs = np.zeros(0, np.int64)
        self.anchors = np.zeros(0, np.uint64)
        if n < least:
            return
        at = self.off
        self.starts, self.anchors = self._spans(gram)
        if len(self.starts):
            self.docs = np.searchsorted(at, self.starts, "right") - 1
            following = np.concatenate([self.starts[1:], [n]])
            self.sizes = np.minimum(following, at[self.docs + 1] - least + 1) - self.starts + least - 1

    def _spans(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of windows with one anchor, the smallest hash of the grams in the window, begin, and the anchors.

        Worked out in pieces that stay in a core's cache, so a very long text needs no more than its bytes beside the spans.
        """
        n, span = len(self.data), self.least - gram + 1
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        windows = n - self.least + 1
        valid = np.ones(windows, bool)  # windows that end in the document they start in
        heads = np.zeros(windows, bool)
        for start, end in zip(self.off[:-1].tolist(), self.off[1:].tolist()):
            valid[max(0, end - self.least + 1) : end] = False
            heads[start : start + 1] = True
        starts, anchors, last = [], [], np.zeros(1, np.uint64)
        step = 1 << 15
        for a in range(0, windows, step):
            b = min(windows, a + step)
            m = b - a + span - 1
            words = np.ndarray(m + gram - 8, np.uint64, padded, a, (1,))  # eight bytes from each place on
            h = words[:m] * BASE
            h += words[gram - 8 : gram - 8 + m] * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
            width = 1
            while width * 2 <= span:
                h = np.minimum(h[:-width], h[width:])
                width *= 2
            if width < span:
                h = np.minimum(h[: -(span - width)], h[span - width :])
            new = np.flatnonzero(((h != np.concatenate([last, h[:-1]])) | heads[a:b]) & valid[a:b])
            starts.append(new + a)
            anchors.append(h[new])
            last = h[-1:]
        return np.concatenate(starts), np.concatenate(anchors)

    def content(self, which: np.ndarray) -> np.ndarray:
        """A hash of the text of each span."""
        n = len(self.data)
        low = powers(STRETCH)[:STRETCH]
        sums = np.zeros(n + 1, np.uint64)
        for x in range(0, n, STRETCH):
            part = BYTE_VALUES[self.data[x : x + STRETCH]] * low[: min(STRETCH, n - x)] * np.uint64(pow(int(BASE), x, 2**64))
            sums[x + 1 : x + 1 + len(part)] = np.cumsum(part, dtype=np.uint64) + sums[x : x + 1]
        a, b = self.starts[which], self.starts[which] + self.sizes[which]
        high = np.array([pow(INVERSE, x, 2**64) for x in range(0, n + 1, STRETCH)], np.uint64)
        inverse = _inverses()[a & (STRETCH - 1)] * high[a // STRETCH]
        return mix((sums[b] - sums[a]) * inverse + (b - a).astype(np.uint64) * BASE)


def _part(anchors: np.ndarray, parts: int) -> np.ndarray:
    return ((anchors >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _short(anchors: np.ndarray) -> np.ndarray:
    return (anchors & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _expand(packed: bytes, kind: type | None = None) -> np.ndarray | bytes:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    return raw if kind is None else np.frombuffer(raw, kind)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


def send_anchors(slab_id: int, slab: Slab, parts: int) -> pa.Table:
    """Distinct anchors of a slab by part: those of one document, and those of several."""
    out: dict[str, list] = {"slab": [], "part": [], "one": [], "several": []}
    if len(slab.anchors):
        anchor, first, inverse = np.unique(slab.anchors, return_index=True, return_inverse=True)
        several = np.zeros(len(anchor), bool)
        several[inverse[slab.keys[slab.docs] != slab.keys[slab.docs[first[inverse]]]]] = True
        for part, rows in _by_part(_part(anchor, parts)):
            out["slab"].append(slab_id)
            out["part"].append(part)
            out["one"].append(_short(anchor[rows[~several[rows]]]).tobytes())
            out["several"].append(_short(anchor[rows[several[rows]]]).tobytes())
    return pa.table({"slab": pa.array(out["slab"], pa.int64()), "part": pa.array(out["part"], pa.int64()), "one": pa.array(out["one"], pa.binary()), "several": pa.array(out["several"], pa.binary())})


def answer_anchors(rows: pa.Table) -> pa.Table:
    """For each slab of a part, which of its anchors occur in two documents or more; one sort of the part's anchors, whatever the number of slabs."""
    one, more = (rows.column(c).to_pylist() for c in ("one", "several"))
    single, several = (np.frombuffer(b"".join(x), np.uint32) for x in (one, more))
    values = np.sort(np.concatenate([single, several]))
    twice = np.unique(np.concatenate([values[1:][values[1:] == values[:-1]], several]))
    sizes = np.array([len(x) // 4 for x in one], np.int64)
    at = np.minimum(np.searchsorted(twice, single), max(0, len(twice) - 1))
    hit = twice[at] == single if len(twice) else np.zeros(len(single), bool)
    bounds = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
    found = single[hit]
    answers = [found[a:b].tobytes() + s for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), more)]
    keep = [k for k, a in enumerate(answers) if a]
    return pa.table({"slab": rows.column("slab").take(pa.array(keep, pa.int64())), "part": rows.column("part").take(pa.array(keep, pa.int64())), "anchors": pa.array([answers[k] for k in keep], pa.binary())})


def send_spans(slab_id: int, slab: Slab, parts: int, answers: pa.Table) -> pa.Table:
    """Distinct texts of the spans whose anchors occur elsewhere, by part, each with the smallest key that has it."""
    out: dict[str, list] = {c: [] for c in ("slab", "part", "content", "anchor", "size", "key", "text")}
    wanted = np.zeros(len(slab.anchors), bool)
    if len(slab.anchors) and answers.num_rows:
        part, short = _part(slab.anchors, parts), _short(slab.anchors)
        mine = (part.astype(np.uint64) << np.uint64(32)) | short
        theirs = np.concatenate([(np.uint64(p) << np.uint64(32)) | np.frombuffer(a, np.uint32).astype(np.uint64) for p, a in zip(answers.column("part").to_pylist(), answers.column("anchors").to_pylist())])
        wanted = np.isin(mine, theirs)
    which = np.flatnonzero(wanted)
    if len(which):
        content = slab.content(which)
        content, first = np.unique(content, return_index=True)  # spans are in order of key, so the first has the smallest
        which = which[first]
        data = slab.data.tobytes()
        for p, rows in _by_part(part[which] * FAN + (_short(slab.anchors[which]) % FAN)):
            own = which[rows]
            out["slab"].append(slab_id)
            out["part"].append(p)
            by_anchor = np.argsort(_short(slab.anchors[own]), kind="stable")
            rows, own = rows[by_anchor], own[by_anchor]
            out["content"].append(content[rows].tobytes())
            out["anchor"].append(_short(slab.anchors[own]).tobytes())
            out["size"].append(_squeeze(slab.sizes[own].astype(np.int32).tobytes()))
            out["key"].append(_squeeze(slab.keys[slab.docs[own]].tobytes()))
            out["text"].append(_squeeze(b"".join([data[a : a + n] for a, n in zip(slab.starts[own].tolist(), slab.sizes[own].tolist())])))
    return pa.table({c: pa.array(v, pa.int64() if c in ("slab", "part") else pa.binary()) for c, v in out.items()}, schema=SPANS)


SPANS = pa.schema([("slab", pa.int64()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("content", "anchor", "size", "key", "text")]])
MARKS = pa.schema([("slab", pa.int64()), ("content", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("key", pa.binary())])


def smallest_carriers(texts: list[bytes], keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text, the smallest key of the texts that hold it, as runs: (text, first window, window behind the last, key)."""
    # 0 ends a text. A text's own 0 bytes are moved out of the way; 0xFF stands in no UTF-8 text.
    joined = np.frombuffer(b"\x00".join([t.replace(b"\x00", b"\xff") for t in texts]) + b"\x00", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    order, group = equal_windows(joined, least)
    good = (order + least) <= (begin + sizes)[owner[order]]
    order, group = order[good], group[good]
    smallest = np.full(len(joined), -1, np.int64)
    if len(order):
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        low = np.minimum.reduceat(keys[owner[order]], cuts)
        smallest[order] = np.repeat(low, np.diff(np.concatenate([cuts, [len(order)]])))
    window = np.zeros(len(joined), bool)
    window[order] = True
    new = window.copy()
    new[1:] &= ~window[:-1] | (smallest[1:] != smallest[:-1])
    first = np.flatnonzero(new)
    ends = window.copy()
    ends[:-1] &= ~window[1:] | (smallest[1:] != smallest[:-1])
    text = owner[first]
    return text, first - begin[text], np.flatnonzero(ends) + 1 - begin[text], smallest[first]


def answer_spans(rows: pa.Table, least: int, batch: int) -> pa.Table:
    """For each slab of a part, the window ranges of its span texts with the smallest key of each; the slab compares its own documents."""
    frames = {c: [np.frombuffer(x, kind) for x in rows.column(c).to_pylist()] for c, kind in (("content", np.uint64), ("anchor", np.uint32))}
    frames |= {c: [_expand(x, kind).astype(np.int64) for x in rows.column(c).to_pylist()] for c, kind in (("size", np.int32), ("key", np.int64))}
    counts = [len(x) for x in frames["key"]]
    slab = np.repeat(rows.column("slab").to_numpy(), counts)
    content, anchor, size, key = (np.concatenate(frames[c]) for c in ("content", "anchor", "size", "key"))
    whole = [_expand(x) for x in rows.column("text").to_pylist()]
    from_row = np.repeat(np.arange(len(counts)), counts)
    at = np.concatenate([np.concatenate([[0], np.cumsum(s)[:-1]]) for s in frames["size"]])
    order = np.lexsort((key, content, anchor))
    slab, content, anchor, size, key, from_row, at = (x[order] for x in (slab, content, anchor, size, key, from_row, at))
    firsts = np.flatnonzero(np.concatenate([[True], (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1])]))
    carriers = np.diff(np.concatenate([firsts, [len(content)]]))
    # A text that has its anchor to itself shares no window with another: one run, with its own smallest key.
    heads = np.concatenate([[True], anchor[firsts][1:] != anchor[firsts][:-1]])
    group = np.flatnonzero(heads)
    texts_of = np.diff(np.concatenate([group, [len(firsts)]]))
    alone = group[texts_of == 1]
    runs = [(alone, np.zeros(len(alone), np.int64), size[firsts[alone]] - least + 1, key[firsts[alone]])]
    # The others in sub-parts of whole anchors.
    rest = np.flatnonzero(np.repeat(texts_of > 1, texts_of))
    edge = np.concatenate([np.flatnonzero(heads[rest]), [len(rest)]])
    ends = np.concatenate([[0], np.cumsum(size[firsts[rest]] + 1)])
    a = 0
    while a < len(edge) - 1:
        b = max(a + 1, int(np.searchsorted(ends[edge], ends[edge[a]] + batch, "right")) - 1)
        mine = rest[edge[a] : edge[b]]
        some = firsts[mine]
        texts = [whole[f][x : x + n] for f, x, n in zip(from_row[some].tolist(), at[some].tolist(), size[some].tolist())]
        text, *found = smallest_carriers(texts, key[some], least)
        runs.append((mine[text], *found))
        a = b
    text, first, last, low = (np.concatenate(x) for x in zip(*runs))
    # Every carrier of a text gets its runs.
    times = carriers[text]
    row = np.repeat(firsts[text], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    run = np.repeat(np.arange(len(text)), times)
    by_slab = np.argsort(slab[row], kind="stable")
    row, run = row[by_slab], run[by_slab]
    cuts = np.flatnonzero(np.concatenate([[True], slab[row][1:] != slab[row][:-1]])) if len(row) else np.zeros(0, np.int64)
    columns = (content[row], first[run].astype(np.int32), last[run].astype(np.int32), low[run])
    return pa.table({"slab": pa.array(slab[row[cuts]], pa.int64()), **{c: pa.array([_squeeze(x.tobytes()) for x in np.split(v, cuts[1:])] if len(cuts) else [], pa.binary()) for c, v in zip(("content", "first", "last", "key"), columns)}}, schema=MARKS)


def covered(slab: Slab, answers: pa.Table) -> np.ndarray:
    """Which bytes of a slab go."""
    n = len(slab.data)
    if not answers.num_rows or not len(slab.starts):
        return np.zeros(n, bool)
    get = lambda c, kind: np.concatenate([_expand(x, kind) for x in answers.column(c).to_pylist()])
    content, first, last, key = get("content", np.uint64), get("first", np.int32).astype(np.int64), get("last", np.int32).astype(np.int64), get("key", np.int64)
    order = np.argsort(content, kind="stable")
    content, first, last, key = content[order], first[order], last[order], key[order]
    own = slab.content(np.arange(len(slab.starts)))
    low, high = np.searchsorted(content, own, "left"), np.searchsorted(content, own, "right")
    span = np.repeat(np.arange(len(own)), high - low)
    row = np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low) - low, high - low)
    hit = (key[row] < slab.keys[slab.docs[span]]) & (last[row] + slab.least - 1 <= slab.sizes[span])
    a = slab.starts[span[hit]] + first[row[hit]]
    b = slab.starts[span[hit]] + last[row[hit]] + slab.least - 1
    depth = np.bincount(a, minlength=n + 1).astype(np.int32)
    depth -= np.bincount(b, minlength=n + 1).astype(np.int32)
    return np.cumsum(depth[:n], dtype=np.int32) > 0


def cut_texts(slab: Slab, gone: np.ndarray) -> pa.Table:
    """key, n_bytes, n_removed, n_spans and the bytes that stay."""
    rows = []
    kept = slab.data[~gone].tobytes()
    left = np.concatenate([[0], np.cumsum(~gone)])
    begins = gone.copy()
    if len(gone):
        begins[1:] &= ~gone[:-1]
        inner = slab.off[1:-1]
        begins[inner[inner < len(gone)]] = gone[inner[inner < len(gone)]]
    runs = np.concatenate([[0], np.cumsum(begins)])
    for k, (a, b) in enumerate(zip(slab.off[:-1].tolist(), slab.off[1:].tolist())):
        rows.append((None if slab.nulls[k] else int(slab.keys[k]), b - a, int(b - a - left[b] + left[a]), int(runs[b] - runs[a]), kept[left[a] : left[b]]))
    kinds = {"key": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(kinds.items(), columns)})


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, gram: int = 16, slab_bytes: int = 1 << 22, batch: int = 1 << 17, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, `kept` (the remaining bytes) or, with `digest`, `kept_sha256`, and the columns in `carry` of every row."""
    _, size = input_bytes(docs, text)
    slabs = max(1, -(-size // slab_bytes))
    parts = max(1, -(-slabs // FAN))
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, text), F.lit(slabs)).alias("slab"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])

    def first(rows: pa.Table) -> pa.Table:
        return send_anchors(rows.column("slab")[0].as_py(), Slab(rows, least, gram), parts)

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return send_spans(rows.column("slab")[0].as_py(), Slab(rows, least, gram), parts, answers) if rows.num_rows else SPANS.empty_table()

    carried = [f"carried_{k}" for k in range(len(carry))]
    last_columns = ", ".join(["kept_sha256 string" if digest else "kept binary", *[f"{c} {docs.schema[name].dataType.simpleString()}" for c, name in zip(carried, carry)]])

    def third(rows: pa.Table, answers: pa.Table) -> pa.Table:
        slab = Slab(rows, least, gram)
        out = cut_texts(slab, covered(slab, answers))
        if digest:
            out = out.set_column(4, "kept_sha256", pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in out.column("kept")], pa.string()))
        for c in carried:
            out = out.append_column(c, rows.column(c).take(slab.order))
        return out

    anchors = dealt.groupBy("slab").applyInArrow(first, "slab long, part long, one binary, several binary")
    common = anchors.groupBy("part").applyInArrow(answer_anchors, "slab long, part long, anchors binary")
    spans = dealt.groupBy("slab").cogroup(common.groupBy("slab")).applyInArrow(second, "slab long, part long, content binary, anchor binary, size binary, key binary, text binary")
    marks = spans.groupBy("part").applyInArrow(lambda t: answer_spans(t, least, batch), "slab long, content binary, first binary, last binary, key binary")
    done = dealt.groupBy("slab").cogroup(marks.groupBy("slab")).applyInArrow(third, f"key long, n_bytes long, n_removed long, n_spans long, {last_columns}")
    return done.withColumnsRenamed({"key": key, **dict(zip(carried, carry))})
