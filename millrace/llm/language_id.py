"""Language identification of whole texts, with spans for texts in several languages.

Words are maximal runs without ASCII punctuation, digits and white space. The script of a word (that of its first letter, from a table of code point
ranges) narrows its languages to those that use the script in the training rows. Each candidate gets the word's log-likelihood from hashed byte n-grams of
one to four bytes over the word with its edges. A Viterbi pass over the words of a text, with a penalty for each change of language, labels
spans; the language with most bytes of labelled words is the text's, and its share is the score.

Most texts need no pass: if no run of words gains more from other languages than one penalty, the constant path is the best one, and a running
maximum shows that. The others go through the full recursion, many texts side by side.

Training takes a bounded sample (`most`) of rows with a language; a table of 2**bits counts for each language is summed on executors and broadcast, its
size fixed by the number of languages.

Defined cases: null texts and texts without a letter are `und` with score 0; texts with letters but no scored word get the commonest language
with score 0; rows with a null key are predicted; repeated rows are predicted alike; without training rows all are `und`; a very long text is passed
over alone, with tables linear in its words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.features import held_out
from millrace.llm.vec import BYTE_VALUES, LOWER, mix, slabs, word_hashes, word_spans

BITS = 17
#: Bytes of distinct words scored at once, and table cells of a Viterbi pass over texts side by side.
PIECE, CELLS = 1 << 20, 1 << 21
ORDERS = 4
#: First and last code point of each script's main ranges.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x531, 0x58F),), "hebrew": ((0x591, 0x5F4),), "arabic": ((0x600, 0x77F),),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "tamil": ((0xB80, 0xBFF),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),), "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
_RANGES = sorted((a, b, k) for k, spans in enumerate(SCRIPTS.values()) for a, b in spans)
_FIRST, _LAST, _SCRIPT = (np.array(c) for c in zip(*_RANGES))
OTHER = len(SCRIPTS)
#: ASCII bytes that are no letter become spaces; letters are lower-cased.
WORDS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)[LOWER]
WORDS = np.array([WORDS[b] for b in range(256)], np.uint8)


def scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script number of each word, by the code point at its start; OTHER outside all ranges."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2 = padded[starts], padded[starts + 1] & 63, padded[starts + 2] & 63
    point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, 0x1FFFF)))
    at = np.maximum(np.searchsorted(_FIRST, point, "right") - 1, 0)
    return np.where((point >= _FIRST[at]) & (point <= _LAST[at]), _SCRIPT[at], OTHER)


def gram_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all n-grams of each word with a space on either side, and the word of each."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    spaced = np.full(int(at[-1]), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(spaced)) - np.repeat(at[:-1], size)
    inside = (inner > 0) & (inner < np.repeat(size, size) - 1)
    spaced[inside] = data[(np.repeat(starts, size) + inner - 1)[inside]]
    values = BYTE_VALUES[spaced]
    places, words = [], []
    rolling = np.zeros(len(spaced), np.uint64)
    for n in range(1, ORDERS + 1):
        rolling = rolling[: len(spaced) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + values[n - 1 :]
        whole = word[: len(rolling)] == word[n - 1 :]
        places.append((mix(rolling[whole] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        words.append(word[: len(rolling)][whole])
    return np.concatenate(places), np.concatenate(words)


class Model:
    """Log-likelihoods by language and table place, and which scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, seen: np.ndarray, rows: np.ndarray, switch: float):
        self.langs, self.switch = langs, switch
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * counts.shape[1])).T.astype(np.float32).copy()
        self.uses = (seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)).T >= 0.01
        self.common = int(rows.argmax()) if len(rows) else 0

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of the distinct words in each language, 0 for words whose script no language uses, and which of them each word is."""
        hashes = word_hashes(data, starts, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        out = np.zeros((len(first), len(self.langs)), np.float32)
        size = np.cumsum(b - a + 2)
        at = 0
        while at < len(first):  # in pieces, since n-grams take many times the words' bytes
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
            places, words = gram_places(data, a[at:to], b[at:to])
            for k in range(len(self.langs)):
                out[at:to, k] = np.bincount(words, weights=self.log[places, k], minlength=to - at) / ORDERS
            at = to
        allowed = np.vstack([self.uses, np.zeros(len(self.langs), bool)])[scripts(data, a, b)]
        out -= out.max(axis=1, keepdims=True)
        return np.where(allowed.any(axis=1)[:, None], np.where(allowed, out, np.float32(-50.0)), np.float32(0.0)), inverse


def _paths(table: np.ndarray, bounds: list[tuple[int, int]], switch: float, word: np.ndarray | None = None) -> list[np.ndarray]:
    """Best paths of several texts side by side, from the scores of words, or of distinct words and which of them each word is.

    The texts of a call should be about equally long, as the tables are as long as the longest.
    """
    word = np.arange(len(table)) if word is None else word
    order = sorted(range(len(bounds)), key=lambda k: bounds[k][0] - bounds[k][1])
    a = np.array([bounds[k][0] for k in order])
    size = np.array([bounds[k][1] - bounds[k][0] for k in order])
    longest = int(size[0])
    value = table[word[a]].astype(np.float64)
    back = np.zeros((longest, len(a)), np.int16)  # the state changed to, where the state does not stay
    stays = np.zeros((longest, len(a), (table.shape[1] + 7) // 8), np.uint8)
    for t in range(1, longest):
        n = int(np.searchsorted(-size, -t, "left"))
        v = value[:n]
        best = v.argmax(axis=1)
        jump = v[np.arange(n), best] - switch
        stay = v >= jump[:, None]
        back[t, :n] = best
        stays[t, :n] = np.packbits(stay, axis=1)
        value[:n] = np.where(stay, v, jump[:, None]) + table[word[a[:n] + t]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bounds)
    for k, name in enumerate(order):
        path = np.empty(size[k], np.int64)
        state = int(value[k].argmax())
        for t in range(int(size[k]) - 1, -1, -1):
            path[t] = state
            if t and not stays[t, k, state >> 3] >> (7 - (state & 7)) & 1:
                state = int(back[t, k])
        out[name] = path
    return out


def label(model: Model, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the starts, ends and languages of its words."""
    plain = WORDS[data]
    starts, ends, bounds = word_spans(plain, off)
    table, word = model.scores(plain, starts, ends) if len(starts) else (np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64))
    paths: list = [None] * (len(off) - 1)
    hard = []
    for k in range(len(off) - 1):
        a, b = int(bounds[k]), int(bounds[k + 1])
        own = table[word[a:b]]
        best = int(own.sum(axis=0, dtype=np.float64).argmax()) if b > a else 0
        paths[k] = np.full(b - a, best)
        if b > a and own.shape[1] > 1:
            others = np.delete(own, best, axis=1).max(axis=1).astype(np.float64) - own[:, best]
            c = np.concatenate([[0.0], np.cumsum(others)])
            if (c - np.minimum.accumulate(c)).max() > model.switch:
                hard.append((a - b, k))
    hard.sort()
    while hard:  # longest first, as many side by side as keep the tables small
        group = [k for _, k in hard[: max(1, CELLS // -hard[0][0])]]
        hard = hard[len(group) :]
        for k, path in zip(group, _paths(table, [(int(bounds[k]), int(bounds[k + 1])) for k in group], model.switch, word)):
            paths[k] = path
    for k, path in enumerate(paths):
        a, b = int(bounds[k]), int(bounds[k + 1])
        yield starts[a:b] - off[k], ends[a:b] - off[k], path


def fit(docs: DataFrame, learn: Column, text: str, lang: str, key: str, most: int, switch: float) -> Model:
    """A model from at most about `most` rows that satisfy `learn` and have a language."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = known.count()
    share = int(min(1.0, most / max(1, n)) * (1 << 40))
    sample = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(1 << 40)) < share).select(text, F.col(lang).alias("lang"))

    parts = min(64, docs.sparkSession.sparkContext.defaultParallelism * 2)  # a table of counts leaves each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part, data, off in slabs(batches, text):
            plain = WORDS[data]
            starts, ends, bounds = word_spans(plain, off)
            langs = np.array(part.column("lang").to_pylist(), object)
            row = np.repeat(np.arange(len(langs)), np.diff(bounds))
            for name in set(langs):
                mine = (langs == name)[row]
                total = counts.setdefault(name, np.zeros((1 << BITS) + OTHER + 2))
                total[-1] += (langs == name).sum()
                if mine.any():
                    total[: 1 << BITS] += np.bincount(gram_places(plain, starts[mine], ends[mine])[0], minlength=1 << BITS)
                    total[1 << BITS : -1] += np.bincount(scripts(plain, starts[mine], ends[mine]), minlength=OTHER + 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v.astype(np.float32).tobytes() for v in counts.values()], pa.binary())], ["lang", "v"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.float32).astype(np.float64) for v in rows.column("v"))
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()]), "v": pa.array([total.tobytes()], pa.binary())})

    found = sample.repartition(parts).mapInArrow(count, "lang string, v binary").groupBy("lang").applyInArrow(add, "lang string, v binary").collect()  # one table of fixed size for each language
    found.sort(key=lambda r: r[0])
    table = np.array([np.frombuffer(r[1]) for r in found]).reshape(-1, (1 << BITS) + OTHER + 2)
    return Model([r[0] for r in found], table[:, : 1 << BITS], table[:, 1 << BITS : -2], table[:, -1], switch)


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 12_000, switch: float = 12.0, spans: bool = True) -> DataFrame:
    """key, lang_pred, score and, unless told otherwise, `spans`: (first byte, byte behind the last, language) of runs of words in one language."""
    model = fit(docs, learn, text, lang, key, most, switch)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    made = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, data, off in slabs(batches, text, 1 << 20):
            predicted, score, runs = [], [], []
            letters = part.column("letters").to_pylist()
            for has, (a, b, path) in zip(letters, label(model, data, off) if model.langs else [(np.zeros(0, np.int64),) * 3] * part.num_rows):
                if not has or not model.langs:
                    predicted.append("und")
                    score.append(0.0)
                    runs.append([])
                    continue
                weight = np.bincount(path, weights=b - a, minlength=len(model.langs))
                total = weight.sum()
                predicted.append(model.langs[int(weight.argmax()) if total else model.common])
                score.append(float(weight.max() / total) if total else 0.0)
                if spans:
                    cuts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, np.int64)
                    last = np.concatenate([cuts[1:], [len(path)]]) - 1 if len(cuts) else cuts
                    runs.append([{"start": int(a[i]), "end": int(b[j]), "lang": model.langs[path[i]]} for i, j in zip(cuts, last)])
            columns = [part.column(key), pa.array(predicted, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, made)] if spans else columns, [key, "lang_pred", "score", "spans"][: 4 if spans else 3])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(key, text, letters).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans)


def predictions(docs: DataFrame, modulus: int = 4, remainder: int = 2, key: str = "doc_id", **more) -> DataFrame:
    """identify() with the rows of one remainder of the key's CRC-32 held out of training."""
    out = identify(docs, ~held_out(F.col(key), modulus, remainder), key=key, **more)
    return out.withColumn("held_out", held_out(F.col(key), modulus, remainder))
