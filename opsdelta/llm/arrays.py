"""Whole Arrow string columns as numpy byte arrays: words, hashes and shingles.

A word is a run of digits, ASCII letters (A-Z count as a-z) and anything outside
ASCII. Work goes through slices of a quarter MB (a word costs some 100 bytes of arrays
for each of its own), so memory is bounded by the slice or, where a single text is longer, by that text. Hashes are polynomials modulo
2^64, taken as differences of a prefix sum, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


class Words(NamedTuple):
    """Words of a slice: byte spans, hashes, and each text's range of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of consecutive rows of text or binary; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of at least `n` powers; only those of a slice's size are kept."""
    usual = SLICE_BYTES + (1 << 16)
    return _slice_powers(usual) if n <= usual else _make_powers(n)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    out = []
    for base in (np.uint64(_BASE), inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_slice_powers = lru_cache(maxsize=1)(_make_powers)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> Words:
    """The words of a slice. `lower=False` keeps the case in the hashes."""
    n = len(data)
    inside = WORD_BYTE[data]
    edge = np.zeros(n + 1, dtype=bool)  # a word may not cross from one text into the next
    edge[offs] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((LOWER[data] if lower else data).astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, offs))


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of k words inside one text."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        h = h * _STEP + w.hashes[j : n - k + 1 + j]
    ok = np.ones(n - k + 1, dtype=bool)
    for j in range(1, k):
        cut = w.first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    at = np.flatnonzero(ok)
    return at, mix(h[at] + np.uint64(k))


def owner(w: Words, at: np.ndarray) -> np.ndarray:
    """The text each word position belongs to."""
    return np.searchsorted(w.first, at, side="right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def row_ids(start: int, n: int) -> np.ndarray:
    """Numbers unique over all tasks of a stage, the same whenever the task runs again."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ((ctx.partitionId() if ctx else 0) << 33) + np.arange(start, start + n, dtype=np.int64)
