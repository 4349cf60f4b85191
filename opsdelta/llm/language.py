"""Language of texts, and of the spans of mixed ones.

The script of a word's first character that has one narrows the languages that may have written it.
Each candidate gets the log-likelihood of the word's byte trigrams (with marks for
its two ends), and Viterbi over the words of a text, with a penalty for switching,
labels them. A text's language is the one that most of its scored words have.

Trigram and script counts are summed over all training rows by Spark; the model is
a table of TABLE rows a language. Only text and label are learnt from.

A null text, or one without a letter, is `und` with score 0. If no word can be
scored the commonest language is taken, with its share as the score. Rows with a
null label teach nothing; without any label every text is `und`. Repeated rows
count each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import documents, in_arrow, narrow

TABLE = 1 << 16
#: Log-likelihood that a change of language costs.
SWITCH = 12.0
#: The most a single word may speak for a language against the mean of the candidates.
LIMIT = 8.0
#: A script stands for a language that writes this share of its words in it.
SHARE = 0.001
#: Languages at most: their counts travel to the driver.
LANGUAGES = 512
#: Languages scored at a time.
BLOCK = 8
#: Scores (of a word for a language) that wait to be labelled together, so that a step of Viterbi serves many texts.
HELD = 1 << 20

# Scripts and their code points, from the Unicode block list.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("cherokee", 0x13A0, 0x13FF),
    ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("kana", 0x3040, 0x30FF), ("thaana", 0x780, 0x7BF), ("syriac", 0x700, 0x74F),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
_NAMES = ["", *dict.fromkeys(s[0] for s in SCRIPTS)]
_ORDER = sorted(SCRIPTS, key=lambda s: s[1])
_LOW = np.array([s[1] for s in _ORDER])
_HIGH = np.array([s[2] for s in _ORDER])
_NUMBER = np.array([_NAMES.index(s[0]) for s in _ORDER])


def _script_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the script of the character that begins at each byte; 0 is none."""
    b = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) if len(data) else np.zeros(0, np.int64) for i in range(4)]
    low = [x & 0x3F for x in b]
    point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | low[1], np.where(b[0] < 0xF0, (b[0] & 0xF) << 12 | low[1] << 6 | low[2], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])))
    i = np.searchsorted(_LOW, point, side="right") - 1
    return np.where((i >= 0) & (point <= _HIGH[np.maximum(i, 0)]), _NUMBER[np.maximum(i, 0)], 0)


def scripts(data: np.ndarray, w: A.Words) -> np.ndarray:
    """The number of the script of each word's first character that has one; 0 is none."""
    number = _script_at(data, w.starts)
    later = np.flatnonzero(number == 0)  # words that open with a digit or a mark: look at all their bytes
    if len(later):
        size = (w.ends - w.starts)[later]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(w.starts[later] - first[:-1], size) + np.arange(first[-1])
        at = at[(data[at] & 0xC0) != 0x80]
        found = _script_at(data, at)
        at, found = at[found > 0], found[found > 0]
        k = np.searchsorted(at, w.starts[later])
        ok = k < len(at)
        ok[ok] = at[k[ok]] < w.ends[later[ok]]
        number[later[ok]] = found[k[ok]]
    return number


def trigrams(data: np.ndarray, w: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): a bucket per byte of the words; word i has buckets[first[i]:first[i + 1]]."""
    low = A.LOWER[data].astype(np.uint32)
    size = w.ends - w.starts
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.starts - first[:-1], size) + np.arange(first[-1])
    before, after = low[np.maximum(at - 1, 0)], low[np.minimum(at + 1, max(len(low) - 1, 0))]
    before[first[:-1]] = 1
    after[first[1:] - 1] = 2
    code = before << np.uint32(16) | low[at] << np.uint32(8) | after
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lo, hi, data, offs in A.slices(batch.column("text")):
            w = A.words(data, offs)
            buckets, first = trigrams(data, w)
            script = scripts(data, w)
            labels = batch.column("lang").slice(lo, hi - lo).to_pylist()
            for i, lang in enumerate(labels):
                a, b = w.first[i], w.first[i + 1]
                if lang not in grams:
                    grams[lang], seen[lang] = np.zeros(TABLE, np.int64), np.zeros(len(_NAMES), np.int64)
                grams[lang] += np.bincount(buckets[first[a] : first[b]], minlength=TABLE)
                seen[lang] += np.bincount(script[a:b], minlength=len(_NAMES))
    for lang in grams:
        for kind, counts in (("gram", grams[lang]), ("script", seen[lang])):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "kind", "at", "n"])


class Model:
    def __init__(self, counts: pa.Table):
        rows = counts.to_pydict()
        self.languages = sorted(set(rows["lang"]))
        if len(self.languages) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} labels")
        index = {x: i for i, x in enumerate(self.languages)}
        grams, script = np.zeros((TABLE, len(index))), np.zeros((len(_NAMES), len(index)))
        for lang, kind, at, n in zip(*rows.values()):
            (grams if kind == "gram" else script)[at, index[lang]] = n
        self.scores = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * TABLE)).astype(np.float32)
        words = script.sum(axis=0)
        self.candidates = script / np.maximum(words, 1) >= SHARE
        self.candidates[0] = False
        self.prior = words / max(words.sum(), 1)

    def word_scores(self, data: np.ndarray, w: A.Words) -> np.ndarray:
        """(word, language): how much the word speaks for each, 0 on average over the candidates."""
        buckets, first = trigrams(data, w)
        raw = np.empty((len(first) - 1, len(self.languages)))
        for a in range(0, raw.shape[1], BLOCK):  # the running sums have a row per byte
            sums = np.concatenate([np.zeros((1, len(self.languages[a : a + BLOCK]))), np.cumsum(self.scores[buckets, a : a + BLOCK], axis=0, dtype=np.float64)])
            raw[:, a : a + BLOCK] = sums[first[1:]] - sums[first[:-1]]
        ok = self.candidates[scripts(data, w)]
        n = ok.sum(axis=1, keepdims=True)
        mean = np.where(ok, raw, 0).sum(axis=1, keepdims=True) / np.maximum(n, 1)
        out = np.where(ok, np.clip(raw - mean, -LIMIT, LIMIT), -LIMIT)
        return np.where(n > 0, out, 0.0).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; text i has the words first[i]:first[i + 1]."""
    labels = np.zeros(len(scores), np.int16)
    size = np.diff(first)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return labels
    sums = np.add.reduceat(scores, first[some], axis=0, dtype=np.float64)
    bound = np.add.reduceat(scores.max(axis=1), first[some], dtype=np.float64)
    best = sums.argmax(axis=1)
    single = bound - sums.max(axis=1) <= switch  # no labelling with a change can win
    mark = np.repeat(best, size[some]).astype(np.int16)
    labels[:] = mark
    hard = some[~single]
    if not len(hard):
        return labels
    hard = hard[np.argsort(-size[hard], kind="stable")]
    begin, length = first[hard], size[hard]
    steps = int(length[0])
    live = np.searchsorted(-length, -np.arange(steps), side="left")  # texts with a word at each step
    ends = np.cumsum(live)
    # the words step by step, so that a step is a slice
    at_step = np.arange(ends[-1]) - np.repeat(ends - live, live)
    order = begin[at_step] + np.repeat(np.arange(steps), live)
    heard, before = scores[order], np.empty((len(order), scores.shape[1]))
    d = np.zeros((len(hard), scores.shape[1]))
    cuts = [0, *ends.tolist()]
    for lo, hi in zip(cuts, cuts[1:]):
        now = d[: hi - lo]
        before[lo:hi] = now
        np.maximum(now, now.max(axis=1, keepdims=True) - switch, out=now)
        now += heard[lo:hi]
    at = d.argmax(axis=1)  # a text's state is left as it was at its last word
    stay = before >= before.max(axis=1, keepdims=True) - switch
    came = np.where(stay, np.arange(scores.shape[1], dtype=np.int16), before.argmax(axis=1).astype(np.int16)[:, None])  # from which label
    found, rows = np.empty(len(order), np.int16), np.arange(len(hard))
    for lo, hi in zip(cuts[-2::-1], cuts[:0:-1]):
        k = hi - lo
        found[lo:hi] = at[:k]
        at[:k] = came[lo:hi][rows[:k], at[:k]]
    labels[order] = found
    return labels


def train(labelled: DataFrame) -> Model:
    """From (text, lang); rows without a label are left out."""
    rows = in_arrow(labelled.where("lang is not null").select("text", "lang"), _counts, "lang string, kind string, at long, n long")
    return Model(rows.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow())


def _predicted(model, switch: float, with_spans: bool):
    def answers(m: Model, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The rows of slices that waited: their words are labelled together, a step for a word of every text."""
        names = [*m.languages, "und"]
        if m.languages:
            scores = np.concatenate([h[3] for h in held])
            begins = np.cumsum([0, *[len(h[3]) for h in held]])
            first = np.concatenate([[0], *[h[2][1:] + b for h, b in zip(held, begins)]])
            every = viterbi(scores, first, switch)
        for k, (ids, letters, first, s) in enumerate(held):
            n = len(ids)
            doc = np.repeat(np.arange(n), np.diff(first))
            pred, score = np.full(n, len(names) - 1), np.zeros(n)
            labels = np.zeros(0, np.int16)
            if m.languages:
                labels = every[begins[k] : begins[k + 1]]
                scored = s.any(axis=1)
                votes = np.bincount(doc[scored] * len(m.languages) + labels[scored], minlength=n * len(m.languages)).reshape(n, -1)
                total = votes.sum(axis=1)
                pred = np.where(total > 0, votes.argmax(axis=1), m.prior.argmax())
                score = np.where(total > 0, votes.max(axis=1) / np.maximum(total, 1), m.prior.max())
                pred[~letters], score[~letters] = len(names) - 1, 0.0
            out = [ids, pa.array([names[i] for i in pred]), pa.array(score), pa.array(np.diff(first).astype(np.int64))]
            if with_spans:
                out.append(pa.array([_runs(labels[a:b], names) for a, b in zip(first[:-1], first[1:])], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "n_words", "spans"][: len(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            held, size = [], 0
            for lo, hi, data, offs in A.slices(batch.column("text")):
                w = A.words(data, offs)
                letters = np.asarray(batch.column("has_letter").slice(lo, hi - lo).fill_null(False))
                s = m.word_scores(data, w) if m.languages else None
                held.append((batch.column("doc_id").slice(lo, hi - lo), letters, w.first, s))
                size += 0 if s is None else s.size
                if size >= HELD:
                    yield from answers(m, held)
                    held, size = [], 0
            if held:
                yield from answers(m, held)

    return run


def _runs(labels: np.ndarray, names: list[str]) -> list[dict]:
    if not len(labels):
        return []
    cut = np.concatenate([[0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)]]).tolist()
    return [{"lang": names[int(labels[a])], "first_word": a, "end_word": b} for a, b in zip(cut[:-1], cut[1:])]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, spans): spans are (lang, first_word, end_word), the end exclusive."""
    docs = narrow(df, doc_id=id_col, text=text_col).withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = ", spans array<struct<lang:string,first_word:long,end_word:long>>" if with_spans else ""
    shared = df.sparkSession.sparkContext.broadcast(model)  # TABLE rows of at most LANGUAGES numbers
    return in_arrow(docs, _predicted(shared, switch, with_spans), f"doc_id {kind}, lang_pred string, score double, n_words long{spans}")


def fold(id_col: str, n: int):
    """The remainder of the id's crc32, by which rows are held out."""
    return F.crc32(F.col(id_col).cast("string")) % n


def fitted(docs: DataFrame) -> Model:
    return train(docs.where(fold("doc_id", 5) != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, fitted(docs))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
