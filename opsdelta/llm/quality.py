"""Text quality: naive Bayes support vectors over hashed n-gram indicators.

Indicators per text: byte trigrams, words and word pairs, and trigrams of word
shapes (case, whether the word before is repeated, what separates it from the
next). Each is scaled by the log ratio of its smoothed frequencies in the two
classes, and a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent. A logistic fit turns margins into scores.

Fitting uses at most about SAMPLE labelled rows (their indicators come from the
executors, FEATURES bits a row at most); scoring covers every row and whole texts.
Labels are learnt from the given labels only; nothing but the text enters a score.

Null and empty texts have no indicators and get the score of the bare intercept.
Without labels of both classes every score is the share of class 1 (or 0.5). Repeated
rows each get a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import documents, in_arrow, narrow
from .language import fold
from .samples import labelled_sample, logistic, platt

#: Labelled rows that the model is fitted to, about.
SAMPLE = 4000
#: Smoothing of the log ratios, weight of the loss, rounds over the rows.
SMOOTHING, COST, ROUNDS = 1.0, 0.1, 20
THRESHOLD = 0.3

_GRAMS, _WORDS, _SHAPES = 1 << 17, 1 << 17, 42**3
FEATURES = _GRAMS + _WORDS + _SHAPES

# What stands behind a word: only blanks, a line break, sentence marks, a bar, an exclamation, quotes or brackets, other symbols.
_MARK = np.full(256, 6, np.uint8)
for _chars, _kind in ((b" ", 0), (b"\n\r\t", 1), (b".,;:?-", 2), (b"|", 3), (b"!", 4), (b"\"'()[]{}<>/_", 5)):
    _MARK[list(_chars)] = _kind


def _shapes(data: np.ndarray, w: A.Words) -> np.ndarray:
    """A number below 42 per word: repeated or not, case (3), what follows (7)."""
    n = len(w.starts)
    same = np.zeros(n, np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[:-1][w.first[:-1] < n]] = 0
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capitals = upper[w.ends] - upper[w.starts]
    case = np.where(capitals == 0, 0, np.where((capitals > 1) & (2 * capitals > w.ends - w.starts), 2, 1))
    mark = _MARK[data[np.minimum(w.ends, len(data) - 1)]].astype(np.int64) if n else np.zeros(0, np.int64)
    behind = _MARK[data[np.minimum(w.ends + 1, len(data) - 1)]].astype(np.int64) if n else mark
    mark = np.where((mark == 0) & (behind == 3), 3, mark)  # a bar between blanks
    mark[w.ends >= len(data)] = 1
    return (same * 3 + case) * 7 + mark


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every occurrence in a slice."""
    w = A.words(data, offs)
    low = data.astype(np.uint32)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
    grams = (code * np.uint32(0x9E3779B1)) >> np.uint32(15)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = owner[:-2] == owner[2:] if len(low) > 2 else np.zeros(0, bool)
    pair_at, pairs = A.ngrams(w, 2)
    one = (w.hashes & np.uint64(_WORDS - 1)).astype(np.int64)
    two = (pairs & np.uint64(_WORDS - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    s = _shapes(data, w)
    three = (s[:-2] * 42 + s[1:-1]) * 42 + s[2:] if len(s) > 2 else np.zeros(0, np.int64)
    whole = doc[:-2] == doc[2:] if len(s) > 2 else np.zeros(0, bool)
    at = [owner[:-2][inside] if len(low) > 2 else owner[:0], doc, doc[pair_at], doc[:-2][whole] if len(s) > 2 else doc[:0]]
    what = [grams[inside].astype(np.int64), _GRAMS + one, _GRAMS + two, _GRAMS + _WORDS + three[whole]]
    return np.concatenate(at), np.concatenate(what)


def _per_text(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text of a slice."""
    at, what = features(data, offs)
    by = np.argsort(at, kind="stable")
    at, what = at[by], what[by]
    cut = np.searchsorted(at, np.arange(len(offs)))
    seen = np.zeros(FEATURES, bool)
    for a, b in zip(cut[:-1], cut[1:]):
        seen[what[a:b]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in A.slices(batch.column("text")):
            rows = []
            for found in _per_text(data, offs):
                if len(found) * 32 < FEATURES:
                    rows.append(b"s" + found.astype("<u4").tobytes())
                else:
                    flags = np.zeros(FEATURES, bool)
                    flags[found] = True
                    rows.append(b"d" + np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), batch.column("place").slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["label", "place", "found"])


def _opened(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1)
    return body.view("<u4").astype(np.int64) if raw[:1] == b"s" else np.flatnonzero(np.unpackbits(body)[:FEATURES])


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of each feature's share in class 1 over its share in class -1."""
    counts = [np.bincount(np.concatenate([r for r, c in zip(rows, y) if c == side]), minlength=FEATURES) + smoothing for side in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights of the indicators, intercept) of the hinge loss, one dual variable at a time."""
    w, b = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            s = scale[r]
            gradient = y[i] * (w[r] @ s + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * s
                b += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4 * cost:
            break
    return w * scale, b


class Model:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.weights = None
        if len(set(labels.tolist())) == 2:
            y = np.where(labels > 0, 1, -1)
            self.weights, self.intercept = dual_descent(rows, y, log_ratios(rows, y))
            margins = np.array([self.weights[r].sum() + self.intercept for r in rows])
            self.slope, self.shift = platt(margins, labels)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offs) - 1, self.share)
        margins = np.array([self.weights[f].sum() + self.intercept for f in _per_text(data, offs)])
        return logistic(self.slope * margins + self.shift)


def fit(docs: DataFrame, labels: DataFrame, label: str, training, size: int = SAMPLE) -> Model:
    """Fit to the sample of rows for which `training` (a condition on doc_id) holds."""
    sample = labelled_sample(docs, labels, label, training, size)
    rows = in_arrow(sample, _indicators, "label int, place long, found binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["place"], r["found"]))
    return Model([_opened(r["found"]) for r in rows], np.array([r["label"] for r in rows], dtype=np.float64))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in A.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(model.value.scores(data, offs))], names=["doc_id", "score"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    docs = narrow(df, doc_id=id_col, text=text_col)
    return in_arrow(docs, _scored(df.sparkSession.sparkContext.broadcast(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
