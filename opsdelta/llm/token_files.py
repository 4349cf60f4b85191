"""Token ids in binary files: canonical, length-limited Huffman codes in independent blocks.

Three steps. (1) Texts are tokenised and the ids, each document's ended by an end
id, are staged, with one row per task that counts its ids. (2) The counts of the whole
table are added up, and package-merge turns
the counts into code lengths of at most `MAX_BITS` (more only if the vocabulary
needs it); codes follow from the lengths alone. (3) Documents are coded, dealt out
by ranges of their id, sorted, and written as blocks.

File format: a folder with `codes` (symbol, length) and `blocks`, Parquet as the
container. A block row holds `bucket` and `block` (their order is the order of
ids), `first` (ids before it in its bucket), `doc_ids`, `n_tokens`, `checkpoints`
and `bits`. Within `bits` each document starts on a byte; `checkpoints` has the bit
offset of every STRIDE-th id of each document, so that any block, and any stretch
of STRIDE ids in it, decodes alone. Decoding is table-driven: the next MAX_BITS
bits index a table of symbol and length, for all stretches of a batch at once.

Ids are integers. Null and empty texts consist of the end id. Rows with a null id come first. Rows
that repeat an id are written next to each other, ordered by their ids' bits.
Other columns are not read. An empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path
from . import arrays as A
from . import word_ids
from .common import documents, in_arrow, narrow

END_ID = 1
MAX_BITS = 16
#: Ids between two checkpoints, ids after which a block is closed, and ids a bucket aims at.
STRIDE, BLOCK, BUCKET = 256, 1 << 16, 1 << 22
#: Bytes of text encoded at a time: more share a count of their ids.
ENCODED = 1 << 20
#: Buckets at most: their sizes are the only thing that travels to the driver.
MOST_BUCKETS = 20_000


def _tokenised(path: str, end_id: int):
    """Rows of ids, and after a task's last one a row that only counts the task's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids.encoder(path)
        last = np.array([end_id], dtype="<u4").tobytes()
        total = np.zeros(0, np.int64)
        kind = pa.int64()
        for batch in batches:
            texts, kind = batch.column("text").fill_null(""), batch.column("doc_id").type
            for lo, hi, _, _ in A.slices(texts, ENCODED):
                out = [x + last for x in encoder.encode(texts.slice(lo, hi - lo).to_pylist())]
                total = added(total, np.bincount(np.frombuffer(b"".join(out), dtype="<u4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()), pa.nulls(hi - lo, pa.list_(pa.int64()))],
                    names=["doc_id", "n_tokens", "ids", "counts"],
                )
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "ids", "counts"])

    return run


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two counts by symbol."""
    if len(a) < len(b):
        a, b = b, a
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most `max_bits` by package-merge; one symbol alone gets one bit."""
    if len(counts) <= 1:
        return dict.fromkeys(counts, 1)
    max_bits = max(max_bits, int(len(counts) - 1).bit_length())
    order = sorted(counts, key=lambda s: (counts[s], s))
    weights = np.array([counts[s] for s in order], dtype=np.float64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []  # per level: weights, and the item's number or -1 for a package
    packages = np.zeros(0)
    for _ in range(max_bits):
        w = np.concatenate([weights, packages])
        item = np.concatenate([np.arange(len(weights)), np.full(len(packages), -1)])
        by = np.argsort(w, kind="stable")
        w, item = w[by], item[by]
        levels.append((w, item))
        packages = w[: len(w) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths = np.zeros(len(order), dtype=np.int64)
    take = 2 * (len(order) - 1)
    for _, item in reversed(levels):  # packages come in order, so the first `take` of a level open the first 2 * packages below
        head = item[:take]
        lengths[head[head >= 0]] += 1
        take = 2 * int((head < 0).sum())
    return {s: int(n) for s, n in zip(order, lengths)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, lengths) indexed by symbol, and the longest length: codes count up by (length, symbol)."""
    size = max(lengths, default=0) + 1
    codes, lens = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    code = previous = 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - previous
        codes[symbol], lens[symbol], previous = code, n, n
        code += 1
    return codes, lens, previous


def decode_table(codes: np.ndarray, lens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next `bits` bits."""
    symbols, widths = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    for s in np.flatnonzero(lens):
        lo = int(codes[s]) << (bits - int(lens[s]))
        hi = lo + (1 << (bits - int(lens[s])))
        symbols[lo:hi], widths[lo:hi] = s, lens[s]
    return symbols, widths


def pack(ids: np.ndarray, first: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of several documents (first[i]:first[i + 1] of ids), each from a byte on: (bytes, byte offsets, bit offset of each id in its document)."""
    n = lens[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    bits = ends[first[1:]] - ends[first[:-1]]
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = ends[:-1] - ends[first[:-1]][of]
    at = starts[of] * 8 + inside
    words = np.zeros(int(starts[-1]) // 8 + 2, dtype=np.uint64)
    word = at >> 6
    shift = 64 - (at & 63) - n
    code = codes[ids]
    fits = shift >= 0
    part = np.where(fits, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    if len(ids):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[heads]] = np.add.reduceat(part, heads)  # the fields do not overlap: a sum is an or
        over = np.flatnonzero(~fits)
        words[word[over] + 1] += code[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: int(starts[-1])], starts, inside


def _coded(codes, lens, bounds):
    """Rows with their bits and the bucket their id falls into; a null id is in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n_bits, edges = codes.value, lens.value, bounds.value
        for batch in batches:
            known = batch.column("doc_id")
            bucket = np.where(known.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edges, known.fill_null(0).to_numpy(), side="left"), 0)
            bucket = pa.array(bucket.astype(np.int32))
            for lo, hi, data, offs in A.slices(batch.column("ids")):
                ids, first = data.view("<u4").astype(np.int64), offs // 4
                packed, starts, inside = pack(ids, first, c, n_bits)
                raw = packed.tobytes()
                marks = [inside[a:b:STRIDE].tolist() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[column.slice(lo, hi - lo) for column in (known, bucket, batch.column("n_tokens"))],
                        pa.array(marks, pa.list_(pa.int64())),
                        pa.array([raw[a:b] for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                    ],
                    names=["doc_id", "bucket", "n_tokens", "checkpoints", "bits"],
                )

    return run


def _blocks(kind: pa.DataType):
    """Sorted documents to blocks. A bucket's rows come together; a document is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"bucket": None, "block": 0, "first": 0}
        open_: dict[str, list] = {"ids": [], "n": [], "marks": [], "bits": []}
        size = bits = 0

        def close() -> pa.RecordBatch:
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([state["bucket"]], pa.int32()), pa.array([state["block"]], pa.int64()), pa.array([state["first"]], pa.int64()),
                    pa.array([open_["ids"]], pa.list_(kind)), pa.array([open_["n"]], pa.list_(pa.int64())), pa.array([open_["marks"]], pa.list_(pa.int64())),
                    pa.array([b"".join(open_["bits"])], pa.binary()),
                ],
                names=["bucket", "block", "first", "doc_ids", "n_tokens", "checkpoints", "bits"],
            )
            state["block"] += 1
            state["first"] += size
            for v in open_.values():
                v.clear()
            return row

        for batch in batches:
            for bucket, doc, n, marks, raw in zip(*[batch.column(k).to_pylist() for k in ("bucket", "doc_id", "n_tokens", "checkpoints", "bits")]):
                if open_["n"] and (bucket != state["bucket"] or size + n > BLOCK):
                    yield close()
                    size = bits = 0
                if bucket != state["bucket"]:
                    state.update(bucket=bucket, block=0, first=0)
                open_["ids"].append(doc)
                open_["n"].append(n)
                open_["marks"] += [m + bits for m in marks]
                open_["bits"].append(raw)
                size += n
                bits += 8 * len(raw)
        if open_["n"]:
            yield close()

    return run


def unpack(bits: np.ndarray, marks: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Ids of stretches that begin at bit `marks[i]` and hold `counts[i]` ids each, one after the other."""
    symbols, widths = table
    padded = np.concatenate([bits, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(starts[-1]), np.uint32)
    by = np.argsort(-counts, kind="stable")
    at, to, left = marks[by].astype(np.int64), starts[:-1][by], counts[by]
    live = len(by)
    mask = np.uint32((1 << width) - 1)
    for step in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -step, side="left"))  # those with more than `step` ids
        p = at[:live]
        value = (window[p >> 3] >> (32 - width - (p & 7)).astype(np.uint32)) & mask
        out[to[:live] + step] = symbols[value]
        p += widths[value]
    return out


def _read(codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lens, width = canonical(codebook.value)
        table = decode_table(codes, lens, max(width, 1))
        for batch in batches:
            for lo, hi, data, offs in A.slices(batch.column("bits")):
                rows = [batch.column(k).slice(lo, hi - lo) for k in ("bucket", "first", "doc_ids", "n_tokens", "checkpoints")]
                n = np.asarray(rows[3].flatten())
                per_row = np.diff(np.asarray(rows[3].offsets))
                pieces = (n + STRIDE - 1) // STRIDE
                counts = np.full(int(pieces.sum()), STRIDE, dtype=np.int64)
                counts[np.cumsum(pieces) - 1] = n - (pieces - 1) * STRIDE
                marks = np.asarray(rows[4].flatten()) + np.repeat(offs[:-1] * 8, np.diff(np.asarray(rows[4].offsets)))
                ids = unpack(data, marks, counts, table, max(width, 1))
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
                before = (ends - n) - np.repeat(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_row)[:-1]])], per_row) + np.repeat(np.asarray(rows[1]), per_row)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows[2].flatten(), pa.array(np.repeat(np.asarray(rows[0]), per_row)), pa.array(before.astype(np.int64)), pa.array(n),
                        pa.array([raw[4 * (e - k) : 4 * e] for k, e in zip(n.tolist(), ends.tolist())], pa.binary()),
                    ],
                    names=["doc_id", "bucket", "before", "n_tokens", "ids"],
                )

    return run


def write_tokens(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, max_bits: int = MAX_BITS) -> str:
    """Encode every text and write the files under `path`, in ascending order of the id."""
    spark = df.sparkSession
    docs = narrow(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids_path = staging_path(spark, "token-ids")
    schema = f"doc_id {kind}, n_tokens long, ids binary, counts array<long>"
    in_arrow(docs, _tokenised(tokenizer, end_id), schema).write.option("compression", "zstd").parquet(ids_path)
    written = spark.read.schema(schema).parquet(ids_path)
    counts = written.where("counts is not null").select(F.posexplode("counts").alias("symbol", "n")).where("n > 0").groupBy("symbol").agg(F.sum("n").alias("n"))
    counted = {r["symbol"]: r["n"] for r in counts.collect()}  # one row per id of the vocabulary
    lengths = code_lengths(counted, max_bits)
    codes, lens, _ = canonical(lengths)
    ids = written.where("n_tokens is not null").drop("counts")
    buckets = int(min(MOST_BUCKETS, max(1, -(-sum(counted.values()) // BUCKET), spark.sparkContext.defaultParallelism)))
    bounds = ids.select(F.percentile_approx("doc_id", F.lit([i / buckets for i in range(1, buckets)]), F.lit(10 * buckets)).alias("b")).first()["b"] if buckets > 1 else None
    bounds = sorted(set(bounds or []))
    context = spark.sparkContext
    coding = [context.broadcast(x) for x in (codes, lens, np.array(bounds, dtype=np.int64))]
    coded = in_arrow(ids, _coded(*coding), f"doc_id {kind}, bucket int, n_tokens long, checkpoints array<long>, bits binary")
    ordered = coded.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "bits")
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    in_arrow(ordered, _blocks(arrow_kind), f"bucket int, block long, first long, doc_ids array<{kind}>, n_tokens array<long>, checkpoints array<long>, bits binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(list(lengths.items()), "symbol long, length int").coalesce(1).write.parquet(f"{path}/codes")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(f"{path}/blocks")
    codebook = spark.sparkContext.broadcast({r["symbol"]: r["length"] for r in spark.read.parquet(f"{path}/codes").collect()})
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = {r["bucket"]: r["n"] for r in blocks.groupBy("bucket").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).collect()}  # MOST_BUCKETS rows at most
    before, total = [], 0
    for b in sorted(sizes):
        before.append((b, total))
        total += sizes[b]
    offsets = F.broadcast(spark.createDataFrame(before, "bucket int, offset long"))
    rows = in_arrow(blocks.select("bucket", "first", "doc_ids", "n_tokens", "checkpoints", "bits"), _read(codebook), f"doc_id {kind}, bucket int, before long, n_tokens long, ids binary")
    return rows.join(offsets, "bucket").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    files = write_tokens(documents(spark, sf_dir), path("word_bpe_49k.json"), staging_path(spark, "token-files"))
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
