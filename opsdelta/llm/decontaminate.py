"""Benchmark passages in documents by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item (all its words, if they
are fewer). Windows and documents are sets of shingles (runs of up to three words).
Since a window must be contained whole, one shingle is prefix enough: its rarest in
the documents. Three steps over whole tables:

1. count the benchmark's shingles in all documents;
2. per window take the rarest shingle; per document report where such a shingle
   stands, with the words around it (one header row a document, so nothing is lost);
3. join on the shingle, bound by position and length (a window that starts before
   the first word or ends after the last cannot match), compare the words, and
   merge the hit spans of each document.

The documents are filtered by a bit map of the benchmark's hashes, whose size is
fixed; the benchmark itself is joined, never broadcast by us. A frequent passage
makes one key hot, which splits as a skewed join: one side has one row per window.

Null and empty texts have no words: nothing is hit. Items without words have no
windows. A null item_id hits words but is no item to list. Repeated document rows
each get their own result; repeated items count once. Empty tables are fine, and
columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import documents, has_bit, hash_bits, in_arrow, narrow, staged

SIZE = 13
SHINGLE = 3
#: A document counts as contaminated from one hit word in this many.
SHARE = 20

_LISTS = "doc_key long, doc_id {id}, n_words long, pos long, shingle long, around array<string>, around_from long"


def _windows(size: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in A.slices(batch.column("text")):
                w = A.words(data, offs)
                low = A.LOWER[data].tobytes()
                texts = [low[s:e].decode() for s, e in zip(w.starts.tolist(), w.ends.tolist())]
                grams = {k: dict(zip(*(x.tolist() for x in _signed(A.ngrams(w, k))))) for k in range(1, shingle + 1)}
                out = {"item": [], "words": [], "offset": [], "shingle": [], "k": []}
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    length = min(size, b - a)
                    k = min(shingle, length)
                    for s in range(a, b - length + 1) if length else ():
                        for o in range(length - k + 1):
                            out["item"].append(lo + i)
                            out["words"].append(texts[s : s + length])
                            out["offset"].append(o)
                            out["shingle"].append(grams[k][s + o])
                            out["k"].append(k)
                ids = batch.column("item_id").take(pa.array(out.pop("item"), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out["words"], pa.list_(pa.string())), pa.array(out["offset"], pa.int64()), pa.array(out["shingle"], pa.int64()), pa.array(out["k"], pa.int32())],
                    names=["item_id", "words", "offset", "shingle", "k"],
                )

    return run


def _signed(grams: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return grams[0], A.signed(grams[1])


def _found(w: A.Words, sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the slice's shingles that the filter lets through."""
    at, hashes = [], []
    for k in sizes:
        p, h = A.ngrams(w, k)
        ok = has_bit(bits, h)
        at.append(p[ok])
        hashes.append(h[ok])
    return (np.concatenate(at), np.concatenate(hashes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _counts(sizes: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in A.slices(batch.column("text")):
                _, hashes = _found(A.words(data, offs), sizes, bits.value)
                h, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(h)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return run


def _places(sizes: list[int], bits, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for lo, hi, data, offs in A.slices(batch.column("text")):
                w = A.words(data, offs)
                n = hi - lo
                keys = A.row_ids(seen, n)
                seen += n
                ids = batch.column("doc_id").slice(lo, n)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), ids, pa.array(np.diff(w.first).astype(np.int64)), none, none, pa.nulls(n, pa.list_(pa.string())), none],
                    names=["doc_key", "doc_id", "n_words", "pos", "shingle", "around", "around_from"],
                )
                at, hashes = _found(w, sizes, bits.value)
                if not len(at):
                    continue
                low = A.LOWER[data].tobytes()
                of = A.owner(w, at)
                begin, end = w.first[of], w.first[of + 1]
                left, right = np.maximum(begin, at - size + 1), np.minimum(end, at + size)
                for c in range(0, len(at), 5000):  # a text full of hits goes out in parts
                    p = slice(c, c + 5000)
                    around = [[low[s:e].decode() for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())] for a, b in zip(left[p], right[p])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[of[p]]), ids.take(pa.array(of[p])), pa.array((end - begin)[p].astype(np.int64)), pa.array((at - begin)[p].astype(np.int64)),
                            pa.array(A.signed(hashes[p])), pa.array(around, pa.list_(pa.string())), pa.array((left - begin)[p].astype(np.int64)),
                        ],
                        names=["doc_key", "doc_id", "n_words", "pos", "shingle", "around", "around_from"],
                    )

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(places, spans): a row per document (doc_key, doc_id, n_words), and a row per

    document, item and occurring window (doc_key, start_word, end_word, item_id), words
    from 0, the end exclusive. Both come from one written table.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    bench = staged(
        in_arrow(benchmark, _windows(size, shingle), f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, words array<string>, offset long, shingle long, k int"),
        "benchmark-windows",
    )
    sizes = sorted(r["k"] for r in bench.select("k").distinct().collect())  # at most `shingle` values
    bits = context.broadcast(hash_bits(bench, "shingle"))
    texts = docs.select("text")
    rarity = in_arrow(texts, _counts(sizes, bits), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    prefixes = staged(
        bench.groupBy("words", "offset", "shingle").agg(F.lit(1).alias("one"))
        .join(rarity, "shingle", "left")
        .groupBy("words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
        .select("words", F.size("words").alias("length"), "rarest.shingle", "rarest.offset"),
        "window-prefixes",
    )
    wanted = context.broadcast(hash_bits(prefixes, "shingle"))
    schema = _LISTS.format(id=docs.schema["doc_id"].dataType.simpleString())
    places = staged(in_arrow(docs, _places(sizes, wanted, size), schema), "window-places")
    start = F.col("pos") - F.col("offset")
    verified = (
        places.where("shingle is not null")
        .join(prefixes, "shingle")
        .where((start >= F.col("around_from")) & (start + F.col("length") <= F.col("n_words")))
        .where(F.slice("around", (start - F.col("around_from") + 1).cast("int"), F.col("length")) == F.col("words"))
        .select("doc_key", start.alias("start_word"), (start + F.col("length")).alias("end_word"), "words")
    )
    spans = verified.join(bench.select("item_id", "words").distinct(), "words").select("doc_key", "start_word", "end_word", "item_id")
    return places.where("shingle is null").select("doc_key", "doc_id", "n_words"), spans


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, share: int = SHARE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = narrow(df, doc_id=id_col, text=text_col)
    headers, spans = find_windows(docs, narrow(benchmark, item_id="item_id", text="text"), size)
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(F.lit(0), x["end_word"] - F.greatest(x["start_word"], s["reach"]))).alias("hit"),
            F.greatest(s["reach"], x["end_word"]).alias("reach"),
        ),
        lambda s: s["hit"],
    )
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hits = spans.groupBy("doc_key").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"), F.collect_set("item_id").alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return headers.join(hits.select("doc_key", union.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", names).alias("names")), "doc_key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as (
  select distinct item_id, len, array_to_string(w[i : i + len - 1], ' ') as win
  from (select item_id, w, least(13, len(w)) as len, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, len, array_to_string(w[i : i + len - 1], ' ') as win
  from (select doc_id, w, len, unnest(range(1, len(w) - len + 2)) as i from d, (select distinct len from bw) where len(w) >= len)),
hit as (select doc_id, i, len, item_id from dw join bw using (len, win)),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + len)) as p from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
       from (select distinct doc_id, item_id::varchar as item_id from hit where item_id is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""
