"""Bounded samples of labelled rows, and the mapping of margins to probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, staged

_PARTS = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, size: int) -> DataFrame:
    """(text, label) of about `size` labelled rows at most, chosen by a hash of the id; staged.

    `training` is a condition on doc_id. Both sides are thinned before they are joined, so
    no table of texts is shuffled. Of several labels of an id the largest counts, and of
    several texts the least, so that rows are as few as ids; rows without a label are left out.
    """
    known = narrow(labels, doc_id="doc_id", label=label).where(F.col("label").isNotNull() & training)
    total = known.count()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(_PARTS))
    chosen = place < int(_PARTS * min(1.0, size / max(total, 1)))
    known = known.where(chosen).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    texts = narrow(docs, doc_id="doc_id", text="text").where(training & chosen)
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return staged(texts.join(known, "doc_id").select("text", "label", place.alias("place")), "labelled-sample")


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic fit by Newton's method with smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
