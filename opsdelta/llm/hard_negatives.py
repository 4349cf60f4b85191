"""Hard negatives of stated anchors by the threshold algorithm over integer vectors.

A component x becomes floor(256 x); scores are integer inner products. Rows are dealt
into blocks of bounded size. A block sorts its rows once along every dimension. An anchor
then reads, in every dimension, the list from the end that its own component's sign makes
the better one, scores by random access what it has not met before, and stops when the
threshold (its product with the row of best values left unread) falls strictly below the
k-th score of every window it has open; an equal threshold goes on, because ties go to
the smaller id. Two rounds do this: the first finds each anchor's best rows of its own
label, the positives; the second the best rows of other labels within a window
[low * s / 100, s] below each positive's score s. Each block returns its best k per
window, and the best k of those are the best of all, so results are exact.

Anchors are a stated query set: each block meets all of them, streamed past the block in
small batches, so that a task holds one block however many anchors there are. Blocks are
dealt by a hash of the row's place, so that no label or repeated id fills one.

Rows with a null id, label or vector, or with a null or non-finite component, take no
part. Vectors of different lengths never meet. An anchor never meets rows of its own id.
Repeated rows are candidates each; anchors that are alike in everything count once.
A negative positive score leaves an empty window. Scores must fit a long. Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, in_arrow, narrow, staged

#: Rows a block aims at, places read from every list at a time at first, and positives and negatives kept.
BLOCK, FIRST_READ, BEST = 4096, 16, 5
#: Tasks of a round at most; each then takes several blocks, one after the other.
TASKS = 1 << 13
#: Scores stay below this in magnitude where products of doubles are exact.
_EXACT = float(1 << 53)
_DONE = np.iinfo(np.int64).max


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v being longs."""
    v = F.transform("vector", lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = narrow(df, vec_id=id_col, vector=vector_col, label=label_col)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    shown = F.col("label") if label is None else label
    return rows.select("vec_id", shown.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


class Block:
    """Rows of one length, with the order of every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        by = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[by], labels[by], vectors[by]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64) if self.largest < 1 << 26 else None
        self.lists: dict = {}
        self.kinds, self.starts = np.unique(self.labels, return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        reach = self.largest * float(np.abs(anchor).sum())
        if self.floats is not None and reach < _EXACT:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def sorted_lists(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo:hi by every dimension, as [ascending, descending][dimension][place]."""
        if (lo, hi) not in self.lists:
            up = np.argsort(self.vectors[lo:hi].T, axis=1, kind="stable").astype(np.int32) + np.int32(lo)
            self.lists[lo, hi] = np.stack([up, up[:, ::-1]])
        return self.lists[lo, hi]

    def best(self, anchor: np.ndarray, lo: int, hi: int, fits: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every window [lows, highs] of scores the k best (scores, ids) of those rows of lo:hi that `fits` allows."""
        n, found = hi - lo, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lows)
        open_ = lows <= highs
        if not n or not open_.any():
            return found
        dims = np.flatnonzero(anchor)
        if not len(dims):  # every score is zero
            read, steps = np.arange(lo, hi), [n]
            lists = None
        else:
            lists, read, steps = self.sorted_lists(lo, hi), None, []
            side = (anchor[dims] > 0).astype(np.int64)
        met = np.zeros(n, dtype=bool)
        at, step = 0, FIRST_READ
        while True:
            if lists is not None:
                to = min(n, at + step)
                head = np.concatenate([lists[s, d, at:to] for s, d in zip(side, dims)]) - lo
                fresh = np.zeros(n, dtype=bool)
                fresh[head] = True
                fresh &= ~met
                met |= fresh
                read, at, step = np.flatnonzero(fresh) + lo, to, 2 * step
            read = read[fits[read - lo]]
            got = self.scores(read, anchor)
            for w in np.flatnonzero(open_):
                inside = (got >= lows[w]) & (got <= highs[w])
                s, i = np.append(found[w][0], got[inside]), np.append(found[w][1], self.ids[read[inside]])
                top = np.lexsort((i, -s))[:k]
                found[w] = s[top], i[top]
            if lists is None or at >= n or met.all():
                return found
            edge = self.vectors[lists[side, dims, at], dims]  # the best value left unread in each list
            threshold = int(sum(int(a) * int(b) for a, b in zip(anchor[dims], edge)))
            for w in np.flatnonzero(open_):
                kth = int(found[w][0][-1]) if len(found[w][0]) == k else int(lows[w])
                open_[w] = threshold >= kth
            if not open_.any():
                return found


def _blocks(meet: Callable, names: list[str]):
    """Per block: its rows first, then every anchor; `meet(block, anchor row, emit)` adds result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, blocks = None, [], {}
        for batch in batches:
            out: list[tuple] = []
            number = batch.column("block").to_numpy()
            anchors = batch.column("key").is_valid().to_numpy(zero_copy_only=False)
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            column = batch.column("v")
            values, offs = column.flatten().to_numpy(), np.asarray(column.offsets)
            offs = offs - offs[0]
            wide = np.diff(offs)
            edges = np.flatnonzero(np.diff(number) | np.diff(anchors.astype(np.int8))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if a == b:
                    continue
                if number[a] != now:
                    now, parts, blocks = number[a], [], {}
                if not anchors[a]:
                    for d in np.unique(wide[a:b]):
                        rows = np.flatnonzero(wide[a:b] == d) + a
                        parts.append((int(d), ids[rows], labels[rows], values[(offs[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)))
                    continue
                if parts:  # the first anchor closes the block
                    for d in {p[0] for p in parts}:
                        same = [p for p in parts if p[0] == d]
                        blocks[d] = Block(*(np.concatenate([p[j] for p in same]) for j in (1, 2, 3)))
                    parts = []
                for r in range(a, b):
                    if int(wide[r]) in blocks:
                        meet(blocks[int(wide[r])], values[offs[r] : offs[r + 1]], int(ids[r]), int(labels[r]), batch, r, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def _positives(k: int):
    whole = np.array([-_DONE]), np.array([_DONE])

    def meet(block: Block, anchor, vec_id, label, batch, r, out) -> None:
        i = int(np.searchsorted(block.kinds, label))
        if i == len(block.kinds) or block.kinds[i] != label:
            return
        lo, hi = int(block.starts[i]), int(block.ends[i])
        [(s, found)] = block.best(anchor, lo, hi, block.ids[lo:hi] != vec_id, *whole, k)
        key = batch.column("key")[r].as_py()
        out += [(key, vec_id, x, y) for x, y in zip(found.tolist(), s.tolist())]

    return _blocks(meet, ["key", "anchor_id", "positive_id", "positive_score"])


def _negatives(k: int, low: int):
    def meet(block: Block, anchor, vec_id, label, batch, r, out) -> None:
        highs = np.array(batch.column("windows")[r].as_py(), dtype=np.int64)
        lows = np.array([-(-low * s // 100) for s in highs.tolist()], dtype=np.int64)  # the least whole score not below low %
        fits = (block.labels != label) & (block.ids != vec_id)
        key = batch.column("key")[r].as_py()
        for high, (s, found) in zip(highs.tolist(), block.best(anchor, 0, len(block.ids), fits, lows, highs, k)):
            out += [(key, high, x, y) for x, y in zip(found.tolist(), s.tolist())]

    return _blocks(meet, ["key", "positive_score", "negative_id", "negative_score"])


def _round(rows: DataFrame, anchors: DataFrame, blocks: int, fn, schema: str) -> DataFrame:
    """Every block of `rows` past all `anchors` (key, vec_id, label, v, windows)."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    columns = ["block", "key", "vec_id", "label", "v", "windows"]
    dealt = rows.select(place.alias("block"), F.lit(None).cast("long").alias("key"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("windows"))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = dealt.select(columns).union(asked.select(columns))
    tasks = min(blocks, TASKS)
    both = both.repartitionById(tasks, F.pmod("block", F.lit(tasks)))
    return in_arrow(both.sortWithinPartitions("block", F.col("key").asc_nulls_first()), fn, schema)


def _first(df: DataFrame, by: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(vec_id))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    label: Column | None = None, k: int = BEST, low: int = 80, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` chooses the query rows and `label` may replace the label; both are conditions on
    `vec_id` and `label`. `low` is the least negative score, in percent of the positive's.
    """
    rows = whole_vectors(df, id_col, vector_col, label_col, label, scale)
    asked = rows.where(anchors).distinct().withColumn("key", F.xxhash64("vec_id", "label", "v")).withColumn("windows", F.lit(None).cast("array<long>"))
    asked = staged(asked, "anchors")
    blocks = max(1, -(-rows.count() // BLOCK))
    near = _first(_round(rows, asked, blocks, _positives(k), "key long, anchor_id long, positive_id long, positive_score long"), ["key"], "positive_score", "positive_id", k)
    near = staged(near, "positives")
    windows = near.groupBy("key").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    again = staged(asked.drop("windows").join(windows, "key"), "anchor-windows")
    far = _round(rows, again, blocks, _negatives(k, low), "key long, positive_score long, negative_id long, negative_score long")
    best = _first(far, ["key", "positive_score"], "negative_score", "negative_id", k)
    return near.drop("rank").join(best, ["key", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from rows a join rows r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over w as rank, vec_id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 5
"""
