"""Packing of documents, in their order, into sequences of a fixed window.

Documents follow one another by id. A sequence is a stretch of that stream of at most
`WINDOW` ids; it costs the ids missing to the window, or nothing if its length is a power
of two, and a penalty for what it cuts where it ends: nothing at the end of a document,
`SENTENCE` ids' worth at the end of a sentence. Inside a sentence longer than `GAP` ids
every GAP-th place may be cut at a penalty of `INSIDE`. The cheapest choice of cuts comes
from dynamic programming over the places; of equal costs fewer sequences win. Up to the
constant p[j], the cost of ending at place j after place i is best[i] + p[i], so the best i
within the window is the head of a monotone queue, and each place enters and leaves it once.
Places at a distance of a power of two are looked up beside it.

The stream is dealt out by ranges of (id, place of the row), which no repeated id can fill,
and a task packs stretches of about `STRETCH` ids, one after the other, each to its end. So
memory is bounded by a stretch and the longest document, and only a stretch's last sequence
is shorter for it. Tasks may be many or few: their number follows from the ids alone.

Null and empty texts consist of the end id. Null ids come first. Rows that repeat an id are
documents each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path
from . import arrays as A
from . import word_ids
from .common import documents, in_arrow, narrow

END_ID = 2
WINDOW = 4096
#: Costs of cuts in ids of padding, and the distance of places inside long sentences.
SENTENCE, INSIDE, GAP = 16, 128, 256
#: Ids of a stretch, and ids a task aims at.
STRETCH, TASK = 1 << 20, 1 << 22
#: A cost in ids is counted in these, beside one for every sequence.
_UNIT = 1 << 32


def choose(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the places to cut at: the first, 0, to the last; neighbours are at most `window` apart."""
    n = len(places)
    p = places.tolist()
    fixed = (np.asarray(penalties, dtype=np.int64) * _UNIT + 1).tolist()
    to, source = _powers(places, window)
    to.append(n)
    best, key, back = [0] * n, [0] * n, [0] * n
    queue, head, at = [0], 0, 0
    for j in range(1, n):
        here = p[j]
        while here - p[queue[head]] > window:
            head += 1
        i = queue[head]
        cost = key[i] + (window - here) * _UNIT
        while to[at] == j:
            if best[source[at]] < cost:
                i = source[at]
                cost = best[i]
            at += 1
        best[j] = cost = cost + fixed[j]
        back[j] = i
        key[j] = value = cost + here * _UNIT
        while len(queue) > head and key[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _powers(places: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(later, earlier) indices of places whose distance is a power of two below the window, ordered by the later."""
    index = np.full(int(places[-1]) + 1, -1, dtype=np.int32)
    index[places] = np.arange(len(places), dtype=np.int32)
    to, source = [], []
    for k in range(int(window - 1).bit_length()):
        later = np.arange(np.searchsorted(places, 1 << k), len(places))
        i = index[places[later] - (1 << k)]
        to.append(later[i >= 0])
        source.append(i[i >= 0])
    to, source = np.concatenate(to), np.concatenate(source)
    by = np.argsort(to, kind="stable")
    return to[by].tolist(), source[by].tolist()


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, gap: int = GAP, sentence: int = SENTENCE, inside: int = INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of a stretch that begins at 0, given the ends of its documents and sentences."""
    ends = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    extra = np.maximum(0, (np.diff(ends) - 1) // gap)
    first = np.repeat(ends[:-1], extra)
    step = np.arange(len(first)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    places = np.sort(np.concatenate([ends, first + step * gap]))
    cost = np.full(int(places[-1]) + 1, inside, dtype=np.int32)
    cost[sentence_ends] = sentence
    cost[doc_ends] = 0
    penalties = cost[places]
    return places, penalties


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = word_ids.encoder(path), 0
        last = np.array([end_id], dtype="<u4").tobytes()
        mark = np.frombuffer(word_ids.MARK, dtype="<u4")[0]
        small = max(encoder.size, end_id + 1) <= 1 << 16  # ids travel in two bytes if all of them fit
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for lo, hi, _, _ in A.slices(texts):
                marked = [x + last for x in encoder.encode_marked(texts.slice(lo, hi - lo).to_pylist())]
                found = np.frombuffer(b"".join(marked), dtype="<u4")
                first = np.cumsum([0, *[len(x) // 4 for x in marked]])
                marks = np.flatnonzero(found == mark)
                at = np.searchsorted(marks, first)  # marks before each text
                ends = (marks - np.arange(len(marks)) - np.repeat((first - at)[:-1], np.diff(at))).astype("<u4")
                ends = [ends[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]
                found, first = found[found != mark], first - at
                lengths, raw = np.diff(first), found.astype("<u2").tobytes() if small else found.tobytes()
                width = 2 if small else 4
                ids = [raw[width * a : width * b] for a, b in zip(first.tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), pa.array(A.row_ids(done, hi - lo)), pa.array(lengths, pa.int64()),
                        pa.array(ends, pa.binary()), pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "row", "n_tokens", "ends", "ids"],
                )
                done += hi - lo

    return run


def _packed(window: int, sentence: int, inside: int):
    def pack(ids: list, kind: pa.DataType, lengths: list[int], ends: list[bytes], raw: list[bytes], done: int) -> tuple[pa.RecordBatch, int]:
        doc_ends = np.cumsum(lengths)
        starts = doc_ends - lengths
        inner = [np.frombuffer(e, dtype="<u4") for e in ends]
        marks = np.concatenate(inner).astype(np.int64) + np.repeat(starts, [len(x) for x in inner])
        places, penalties = candidates(doc_ends, marks[marks > 0], sentence=sentence, inside=inside)
        cuts = places[choose(places, penalties, window)]
        first = np.union1d(cuts[:-1], starts)
        length = np.diff(np.append(first, doc_ends[-1]))
        doc = np.searchsorted(starts, first, side="right") - 1
        sequence = np.searchsorted(cuts, first, side="right") - 1
        data = b"".join(raw)
        data = np.frombuffer(data, dtype=f"<u{len(data) // int(doc_ends[-1])}").astype("<u4").tobytes()
        numbers = A.row_ids(done, len(cuts) - 1)
        pieces = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[d] for d in doc.tolist()], kind), pa.array(first - starts[doc]), pa.array(length), pa.array(np.asarray(lengths)[doc]),
                pa.array(numbers[sequence]), pa.array(first - cuts[sequence]), pa.array(pieces, pa.binary()),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        ), done + len(cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size = done = 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ends", "ids")]):
                for column, value in zip(held, row):
                    column.append(value)
                size += row[1]
                if size >= STRETCH:
                    out, done = pack(held[0], kind, *held[1:], done)
                    yield out
                    held, size = [[], [], [], []], 0
        if size:
            yield pack(held[0], kind, *held[1:], done)[0]

    return run


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    window: int = WINDOW, sentence: int = SENTENCE, inside: int = INSIDE,
) -> DataFrame:
    """Pieces of the sequences: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    `ids` are little-endian unsigned 32-bit integers. `window` is at least GAP.
    """
    spark = df.sparkSession
    docs = narrow(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    path, seen = staging_path(spark, "packing"), Observation()
    schema = f"doc_id {kind}, row long, n_tokens long, ends binary, ids binary"
    tokenised = in_arrow(docs, _tokenised(tokenizer, end_id), schema).observe(seen, F.sum("n_tokens").alias("n"))
    tokenised.write.option("compression", "zstd").parquet(path)
    tasks = max(1, -(-(seen.get["n"] or 0) // TASK))
    stream = spark.read.schema(schema).parquet(path).repartitionByRange(tasks, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return in_arrow(stream, _packed(window, sentence, inside), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    pieces = pack_documents(documents(spark, sf_dir), path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
