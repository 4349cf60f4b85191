"""Toxicity: a bidirectional gated recurrent network over all overlapping windows.

A word's input is a learnt vector of its hash plus the greatest components of learnt
vectors of its byte n-grams (five and seven long, with marks for the word's ends). Two gated
recurrent units read a window of WINDOW words in both directions; attention weights
the states, and a linear layer turns the pooled state into a logit. Windows overlap
by half; a text's score is that of its worst window, through a logistic fit.

The network is trained in numpy, with Adam, on the driver: on a few windows each of
at most about SAMPLE labelled rows, chosen on the executors by how much oftener
their words occur in texts of label 1. Of a toxic text, each round learns from the
window that scores highest. A fifth of the sample is kept for the logistic fit.
Scoring covers every row and all windows of whole texts; labels are learnt only from
the given labels, and nothing but the text enters a score.

Null and empty texts, and texts without words, have no window and score 0. Without
labels of both classes every score is the share of class 1. Repeated rows each get
a row; other columns are not read.
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
SAMPLE = 6000
WINDOW, STRIDE = 32, 16
#: Windows of a labelled text that training sees.
CHOSEN = 3
TABLE = 1 << 15
INPUT, HIDDEN = 12, 8
ROUNDS, BATCH, RATE = 10, 256, 0.01
#: Texts added to the observed and to the expected count of a bucket.
SHRINK = 5.0
THRESHOLD = 0.7


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, five-gram buckets, seven-gram buckets, first): a pair of n-grams per byte, word i has first[i]:first[i + 1]."""
    low = A.LOWER[data].astype(np.uint32)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)])
    begin, end = np.repeat(starts, size), np.repeat(ends, size)
    at = np.repeat(starts - first[:-1], size) + np.arange(first[-1])
    last = max(len(low) - 1, 0)
    byte = [np.where(at + d < begin, np.uint32(1), np.where(at + d >= end, np.uint32(2), low[np.clip(at + d, 0, last)])) if len(at) else at.astype(np.uint32) for d in range(-3, 4)]
    five = _wider(byte[2] << np.uint32(16) | byte[3] << np.uint32(8) | byte[4], byte[1], byte[5])
    seven = _wider(five, byte[0], byte[6])
    return (hashes & np.uint64(TABLE - 1)).astype(np.int64), (five >> np.uint32(17)).astype(np.int64), (seven >> np.uint32(17)).astype(np.int64), first


def _wider(h: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of an n-gram with a byte more on either side."""
    h = (h * np.uint32(0x85EBCA6B)) ^ (left << np.uint32(20) | right << np.uint32(3))
    return (h ^ h >> np.uint32(15)) * np.uint32(0x9E3779B1)


def distinct(data: np.ndarray, w: A.Words) -> tuple[tuple, np.ndarray]:
    """Features of the distinct words of a slice, and the number of each word."""
    _, at, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    return word_features(data, w.starts[at], w.ends[at], w.hashes[at]), number


def segment_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest value of each word's stretch; no word is empty."""
    return np.maximum.reduceat(values, first[:-1], axis=0) if len(first) > 1 else values[:0]


def windows(w: A.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of all windows: every STRIDE words, and the last one flush with the end."""
    n = np.diff(w.first)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n[text], WINDOW)
    return text, w.first[text] + np.minimum(k * STRIDE, n[text] - length), length


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class each bucket occurs."""
    counts = np.zeros((2, 3 * TABLE), np.int64)
    for batch in batches:
        for lo, hi, data, offs in A.slices(batch.column("text")):
            w = A.words(data, offs)
            for i, label in enumerate(batch.column("label").slice(lo, hi - lo).to_pylist()):
                a, b = w.first[i], w.first[i + 1]
                word, five, seven, _ = word_features(data, w.starts[a:b], w.ends[a:b], w.hashes[a:b])
                counts[int(label > 0), np.unique(np.concatenate([word, TABLE + five, 2 * TABLE + seven]))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["at", "n0", "n1"])


def lift(counts: pa.Table, share: float) -> np.ndarray:
    """Per bucket the log of its texts of class 1 over those expected, shrunk towards 0."""
    out = np.zeros(3 * TABLE, np.float32)
    at, n0, n1 = (np.asarray(counts.column(c)) for c in ("at", "n0", "n1"))
    out[at] = np.log((n1 + SHRINK) / ((n0 + n1) * share + SHRINK))
    return out


def _chosen(lifts):
    """The windows of each text with the most telling words, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lifts.value
        for batch in batches:
            for lo, hi, data, offs in A.slices(batch.column("text")):
                w = A.words(data, offs)
                (word, five, seven, first), number = distinct(data, w)
                rated = np.maximum(np.maximum(table[word], 0), segment_max(np.maximum(table[TABLE + five], table[2 * TABLE + seven]), first))
                value = np.concatenate([[0], np.cumsum(rated[number] ** 2)])
                text, start, length = windows(w)
                score = value[start + length] - value[start]
                by = np.lexsort((start, -score, text))
                rank = np.arange(len(by)) - np.searchsorted(text[by], text[by], side="left")
                by = by[rank < CHOSEN]
                out = [b" ".join(A.LOWER[data[w.starts[i] : w.ends[i]]].tobytes() for i in range(start[b], start[b] + length[b])).decode() for b in by]
                rows = pa.array(text[by])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("label").take(rows), part.column("place").take(rows), part.column("key").take(rows), pa.array(out, pa.string())], names=["label", "place", "key", "window"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 3, lifts: np.ndarray | None = None):
        g = np.random.default_rng(seed)
        small = lambda *shape: g.normal(0, 0.05, shape).astype(np.float32)
        self.p = {"word": small(TABLE, INPUT), "five": small(TABLE, INPUT), "seven": small(TABLE, INPUT)}
        if lifts is not None:  # the first component starts as the lift
            for i, k in enumerate(("word", "five", "seven")):
                self.p[k][:, 0] = lifts[i * TABLE : (i + 1) * TABLE]
        for d in "fb":
            self.p |= {f"w{d}": g.normal(0, INPUT**-0.5, (INPUT, 3 * HIDDEN)).astype(np.float32), f"u{d}": g.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
            self.p |= {f"a{d}": small(HIDDEN), f"o{d}": g.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)}
        self.p["bias"] = np.zeros(1, np.float32)

    def inputs(self, features: tuple) -> np.ndarray:
        word, five, seven, first = features
        return (self.p["word"][word] + segment_max(self.p["five"][five] + self.p["seven"][seven], first)).astype(np.float32)

    def _step(self, d: str, x: np.ndarray, h: np.ndarray):
        g = h @ self.p[f"u{d}"]
        z = _sigmoid(x[:, :HIDDEN] + g[:, :HIDDEN])
        r = _sigmoid(x[:, HIDDEN : 2 * HIDDEN] + g[:, HIDDEN : 2 * HIDDEN])
        n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        return z, r, n, g[:, 2 * HIDDEN :], n + z * (h - n)

    def logits(self, words: np.ndarray, index: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Per window: `index` has a row of `words` per place, `live` which places are filled (all by default)."""
        out = np.zeros(len(index), np.float32)
        side = {d: words @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}
        steps = index.shape[1]
        for c in range(0, len(index), 4096):
            at, mask = index[c : c + 4096], None if live is None else live[c : c + 4096]
            attention, value = (np.zeros((steps, len(at)), np.float32) for _ in range(2))
            for d in "fb":
                h = np.zeros((len(at), HIDDEN), np.float32)
                read = np.stack([self.p[f"a{d}"], self.p[f"o{d}"]], axis=1)
                for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                    new = self._step(d, side[d][at[:, t]], h)[-1]
                    h = new if mask is None else np.where(mask[:, t : t + 1], new, h)
                    both = h @ read
                    attention[t] += both[:, 0]
                    value[t] += both[:, 1]
            if mask is not None:
                attention[~mask.T] = -np.inf
            e = np.exp(attention - attention.max(axis=0))
            out[c : c + 4096] = (e * value).sum(axis=0) / e.sum(axis=0) + self.p["bias"]
        return out

    def gradients(self, features: tuple, index: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch whose words are `features` (back-propagation through time)."""
        word, five, seven, first = features
        grams = self.p["five"][five] + self.p["seven"][seven]
        highest = segment_max(grams, first)
        words = self.p["word"][word] + highest
        steps, n = index.shape[1], len(index)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "five", "seven")}
        past: dict[str, list] = {}
        states = {}
        for d in "fb":
            x = words @ self.p[f"w{d}"] + self.p[f"c{d}"]
            h, past[d], states[d] = np.zeros((n, HIDDEN), np.float32), [None] * steps, np.zeros((steps, n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z, r, m, u, new = self._step(d, x[index[:, t]], h)
                past[d][t] = (z, r, m, u, h)
                h = np.where(live[:, t : t + 1], new, h)
                states[d][t] = h
        attention = states["f"] @ self.p["af"] + states["b"] @ self.p["ab"]
        attention[~live.T] = -np.inf
        e = np.exp(attention - attention.max(axis=0))
        share = e / e.sum(axis=0)
        value = states["f"] @ self.p["of"] + states["b"] @ self.p["ob"]
        logit = (share * value).sum(axis=0) + self.p["bias"]
        p = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())
        dl = (weight * (p - y) / weight.sum()).astype(np.float32)
        g["bias"][:] = dl.sum()
        dvalue = share * dl
        dattention = share * (value - (share * value).sum(axis=0)) * dl
        dwords = np.zeros_like(words)
        for d in "fb":
            g[f"o{d}"], g[f"a{d}"] = np.einsum("tn,tnh->h", dvalue, states[d]), np.einsum("tn,tnh->h", dattention, states[d])
            dstate = dvalue[..., None] * self.p[f"o{d}"] + dattention[..., None] * self.p[f"a{d}"]
            dh, dx = np.zeros((n, HIDDEN), np.float32), np.zeros((len(words), 3 * HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                z, r, m, u, h = past[d][t]
                on = live[:, t : t + 1]
                dh = dh + dstate[t]
                dn, dz = dh * (1 - z) * (1 - m * m), dh * (h - m) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                inner = np.where(on, np.concatenate([dz, dr, dn * r], axis=1), 0)
                g[f"u{d}"] += h.T @ inner
                outer = np.where(on, np.concatenate([dz, dr, dn], axis=1), 0)
                np.add.at(dx, index[:, t], outer)
                dh = np.where(on, dh * z, dh) + inner @ self.p[f"u{d}"].T
            g[f"w{d}"], g[f"c{d}"] = words.T @ dx, dx.sum(axis=0)
            dwords += dx @ self.p[f"w{d}"].T
        size = np.diff(first)
        per_gram = np.where(grams == np.repeat(highest, size, axis=0), np.repeat(dwords, size, axis=0), 0)
        for k, at, dv in (("word", word, dwords), ("five", five, per_gram), ("seven", seven, per_gram)):
            rows, back = np.unique(at, return_inverse=True)
            summed = np.zeros((len(rows), INPUT), np.float32)
            np.add.at(summed, back, dv)
            g[k] = (rows, summed)
        return loss, g


class Adam:
    """Dense and row-wise updates."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def update(self, g: dict) -> None:
        self.t += 1
        step = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, grad in g.items():
            at, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * grad
            self.v[k][at] = v = 0.999 * self.v[k][at] + 0.001 * grad * grad
            self.p[k][at] -= step * m / (np.sqrt(v) + 1e-8)


def _tensor(texts: list[str]) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(features of the distinct words, index, live) of windows given as texts."""
    column = pa.array(texts, pa.large_string())
    data = np.frombuffer(column.buffers()[2], np.uint8)
    offs = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
    w = A.words(data, offs)
    features, number = distinct(data, w)
    n = np.diff(w.first)
    live = np.arange(WINDOW) < n[:, None]
    index = np.zeros(live.shape, np.int64)
    index[live] = number
    return features, index, live


def _subset(features: tuple, index: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The words that `index` uses, and the index into those."""
    word, five, seven, first = features
    used, back = np.unique(index, return_inverse=True)
    size = (first[1:] - first[:-1])[used]
    cut = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1][used] - cut[:-1], size) + np.arange(cut[-1])
    return (word[used], five[at], seven[at], cut), back.reshape(index.shape)


def learn(texts: list[str], labels: np.ndarray, keys: np.ndarray, lifts: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> Network:
    """Train on windows; `keys` says which belong to one text."""
    net = Network(seed, lifts)
    features, index, live = _tensor(texts)
    adam = Adam(net.p, RATE)
    random = np.random.default_rng(seed)
    positive = labels > 0
    for k in range(rounds):
        if k:
            score = net.logits(net.inputs(features), index, live)
        else:
            score = -np.arange(len(labels), dtype=np.float32)  # windows of a text come best first
        by = np.lexsort((-score, keys))
        best = by[np.concatenate([[True], keys[by][1:] != keys[by][:-1]])]
        rows = np.concatenate([best[positive[best]], np.flatnonzero(~positive)])
        weight = np.where(positive, 0.5 * max(1.0, (~positive).sum() / max(1, positive[best].sum())), 1.0)
        adam.rate = RATE * (1 - k / rounds)
        for part in np.array_split(random.permutation(rows), -(-len(rows) // BATCH)):
            own, at = _subset(features, index[part])
            adam.update(net.gradients(own, at, live[part], labels[part].astype(np.float32), weight[part].astype(np.float32))[1])
    return net


class Model:
    def __init__(self, net: Network | None, share: float, slope: float = 1.0, shift: float = 0.0):
        self.net, self.share, self.slope, self.shift = net, share, slope, shift

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The highest logit of each text's windows; minus infinity without any."""
        w = A.words(data, offs)
        out = np.full(len(offs) - 1, -np.inf)
        if not len(w.hashes):
            return out
        features, number = distinct(data, w)
        words = self.net.inputs(features)
        text, start, length = windows(w)
        full = length == WINDOW
        for rows, live in ((np.flatnonzero(full), None), (np.flatnonzero(~full), np.arange(WINDOW) < length[~full][:, None])):
            if len(rows):
                at = number[np.minimum(start[rows][:, None] + np.arange(WINDOW), len(number) - 1)]
                np.maximum.at(out, text[rows], self.net.logits(words, at, live))
        return out

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(logits), logistic(self.slope * np.where(np.isfinite(logits), logits, 0) + self.shift), 0.0)


def _logits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            for lo, hi, data, offs in A.slices(batch.column("text"), 1 << 22):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(model.value.logits(data, offs))], names=[*[batch.schema.names[i] for i in keep], "logit"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, training, size: int = SAMPLE) -> Model:
    """Fit to the sample of rows for which `training` (a condition on doc_id) holds."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, training, size).withColumn("key", F.xxhash64("text", "place"))
    n, n1 = sample.agg(F.count("label"), F.sum((F.col("label") > 0).cast("int"))).first()
    share = (n1 or 0) / n if n else 0.5
    if share in (0.0, 1.0) or not n:
        return Model(None, share)
    counts = in_arrow(sample.select("text", "label"), _class_counts, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lifts = lift(counts.toArrow(), share)
    last = F.col("place") % 5 == 0
    chosen = in_arrow(sample.where(~last), _chosen(spark.sparkContext.broadcast(lifts)), "label int, place long, key long, window string").withColumn("rank", F.monotonically_increasing_id())
    rows = sorted(chosen.toArrow().to_pylist(), key=lambda r: (r["place"], r["key"], r["rank"]))
    net = learn([r["window"] for r in rows], np.array([r["label"] for r in rows]), np.array([r["key"] for r in rows]), lifts)
    model = Model(net, share)
    kept = in_arrow(sample.where(last).select("text", "label"), _logits(spark.sparkContext.broadcast(model)), "label int, logit double").toArrow()
    logit, y = np.asarray(kept.column("logit")), np.asarray(kept.column("label")).astype(np.float64)
    ok = np.isfinite(logit)
    model.slope, model.shift = platt(logit[ok], y[ok])
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    docs = narrow(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model.net is None:
        return docs.select("doc_id", F.lit(model.share).alias("score"))
    logits = in_arrow(docs, _logits(df.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, logit double")
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), model.slope * F.col("logit") + model.shift))
    return logits.select("doc_id", F.when(F.col("logit") == float("-inf"), 0.0).otherwise(1 / (1 + F.exp(-x))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"), "toxic", fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
