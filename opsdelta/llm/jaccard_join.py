"""Near-duplicate texts: a Jaccard join over word shingles by MinHash prefixes.

Texts are sets of shingles of five words (one shingle of all words, if fewer).
Texts with the same set are one node; copies are never expanded. A node has TREES
times `deepest` MinHash values. A tree's prefix of some length is a key, and nodes that
share it are candidates. The lengths are fixed, the same for all nodes (8 and 5 by
default), in place of a forest's sorted tries that shorten by what matched: the last is
the longest at which the chance that two nodes at the threshold share a key in some
tree, 1 - (1 - t^k)^TREES, reaches the target recall.

At each length the nodes of a key are compared with the key's least node. A last
round at the shortest length compares, within a key, the nodes that are still in
different groups: all those outside the key's largest group with all others, unless
a bound rules the threshold out. The bound comes from BITS bits a node, one per
residue of its shingles' hashes: a bit that only one of two sets occupies is a
shingle that only it has. So two candidates are compared, provably apart, or already
in one group, and no link that joins groups is lost, while a group of thousands
costs a few comparisons a member. Once the groups are known, every two nodes of one
are compared, for the number of links: a group is dealt out in blocks, and two blocks
meet as matrices whose product is what each two sets have in common.
Comparisons are exact, on the 64-bit hashes of all shingles; pairs whose set sizes
rule out the threshold are left out before.

Words are runs of digits, letters (A-Z as a-z) and anything outside ASCII. A text
without words (null, empty) is its own class. Repeated rows are copies. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import documents, has_bit, hash_bits, in_arrow, narrow, staged
from .groups import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES, DEEPEST, SHORTEN = 24, 8, 3
#: Bits a node for the bound on what two sets have in common.
BITS = 2048
#: Nodes and shingles that a block of a group has, as a rule, and shingles that are compared at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048
#: Sets that a task remembers, only to emit the same set less often.
REMEMBERED = 200_000


def recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets of that similarity share a prefix of `depth` in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def depths(threshold: float = THRESHOLD, target: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> list[int]:
    """Prefix lengths in the order of the rounds; the last one is the longest that reaches the target."""
    last = next((k for k in range(deepest, 0, -1) if recall(threshold, k, trees) >= target), 1)
    return [*range(deepest, last, -SHORTEN), last]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): text i has the ascending distinct hashes[first[i]:first[i + 1]]."""
    w = A.words(data, offs)
    n = np.diff(w.first)
    at, hashes = A.ngrams(w, k)
    doc = A.owner(w, at)
    for short in range(1, k):
        texts = np.flatnonzero(n == short)
        if len(texts):
            p, h = A.ngrams(w, short)
            where = np.searchsorted(p, w.first[texts])
            doc, hashes = np.concatenate([doc, texts]), np.concatenate([hashes, h[where]])
    by = np.lexsort((hashes, doc))
    doc, hashes = doc[by], hashes[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(offs)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def nodes(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 16-byte name for each text's set; None for an empty one."""
    low = _sums(A.mix(hashes), first)
    high = _sums(A.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    both = np.stack([high, low], axis=1).astype(">u8").tobytes()
    return [both[16 * i : 16 * i + 16] if b > a else None for i, (a, b) in enumerate(zip(first[:-1], first[1:]))]


def forest_keys(hashes: np.ndarray, first: np.ndarray, lengths: list[int], trees: int = TREES) -> np.ndarray:
    """(text, length, tree): a hash of each tree's prefix. Texts must not be empty."""
    random = np.random.default_rng(20240229)
    factors = random.integers(0, 1 << 62, (trees, max(lengths)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(first) - 1, len(lengths), trees), np.uint64)
    for tree in range(trees):
        key = np.full(len(first) - 1, tree + 1, np.uint64)
        for depth in range(max(lengths)):
            value = np.minimum.reduceat(hashes * factors[tree, depth], first[:-1])
            key = A.mix(key ^ A.mix(value + np.uint64(depth)))
            for i, length in enumerate(lengths):
                if length == depth + 1:
                    out[:, i, tree] = key
    return out


def _signed(lengths: list[int], k: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, hi, data, offs in A.slices(batch.column("text")):
                hashes, first = shingle_sets(data, offs, k)
                names = nodes(hashes, first)
                fresh = []
                for i, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        fresh.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                keys: list = [None] * len(names)
                bits: list = [None] * len(names)
                if fresh:
                    size = np.diff(first)[fresh]
                    cut = np.concatenate([[0], np.cumsum(size)])
                    own = hashes[np.repeat(first[:-1][fresh] - cut[:-1], size) + np.arange(cut[-1])]
                    for i, row in zip(fresh, A.signed(forest_keys(own, cut, lengths, trees)).reshape(len(fresh), -1).tolist()):
                        keys[i] = row
                    flags = np.zeros((len(fresh), BITS), bool)
                    flags[np.repeat(np.arange(len(fresh)), size), (own & np.uint64(BITS - 1)).astype(np.int64)] = True
                    for i, row in zip(fresh, np.packbits(flags, axis=1).view(np.int64).tolist()):
                        bits[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(np.diff(first).astype(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "node", "n_shingles", "keys", "bits"],
                )

    return run


def _sets(k: int, wanted):
    """The shingle sets of the nodes that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, offs in A.slices(batch.column("text")):
                hashes, first = shingle_sets(data, offs, k)
                names = nodes(hashes, first)
                low = np.array([int.from_bytes(x[8:], "big") if x else 0 for x in names], np.uint64)
                rows = [i for i in np.flatnonzero(has_bit(wanted.value, low)) if names[i] is not None and names[i] not in seen]
                rows = list({names[i]: i for i in rows}.values())
                seen.update(names[i] for i in rows)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in rows], pa.binary()), pa.array([hashes[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "hashes"]
                )

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(c) for c in ("a", "b", "left", "right"))
            keep = []
            for i in range(len(a)):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common >= threshold * (len(both) - common) - 1e-9:
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])

    return run


def shared(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many hashes each set has in common with each of `right`, or with each of its own list."""
    both = [*left, *(right or [])]
    size = [len(s) for s in both]
    hashes, row = np.concatenate(both), np.repeat(np.arange(len(both)), size)
    by = np.argsort(hashes, kind="stable")
    hashes, row = hashes[by], row[by]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    n = len(left)
    out = np.zeros((n, n if right is None else len(right)), np.int64)
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(both), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        out += (has[:n] @ (has if right is None else has[n:]).T).astype(np.int64)
    return out


def _within(threshold: float, pairs: bool):
    """Of rows sorted by (root, lo, hi): the links between the slots lo and hi, as pairs or as a count per node."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hashes = batch.column("hashes")
            for i, (*block, slot, node) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("root", "lo", "hi", "slot", "node")])):
                yield block, slot, node, np.frombuffer(hashes[i].as_buffer(), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), block in groupby(rows(batches), lambda r: r[0]):
            block = list(block)
            x, y = ([r for r in block if r[1] == slot] for slot in (lo, hi))
            if not x or not y:
                continue
            common = shared([r[3] for r in x], None if lo == hi else [r[3] for r in y])
            total = np.array([len(r[3]) for r in x])[:, None] + np.array([len(r[3]) for r in y])
            linked = common >= threshold * (total - common) - 1e-9
            if lo == hi:
                np.fill_diagonal(linked, False)
            if pairs:
                a, b = np.nonzero(np.triu(linked) if lo == hi else linked)
                ends = [(min(x[i][2], y[k][2]), max(x[i][2], y[k][2])) for i, k in zip(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.binary()) for i in (0, 1)], names=["a", "b"])
            else:
                names, counts = [r[2] for r in x], linked.sum(axis=1)
                if lo != hi:
                    names, counts = names + [r[2] for r in y], np.concatenate([counts, linked.sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts.astype(np.int64))], names=["node", "n_links"])

    return run


class Forest:
    """The tables of one join: members (doc_id, node), nodes with their keys, and sets of candidates."""

    def __init__(self, docs: DataFrame, threshold: float, target: float, shingle: int, trees: int):
        self.threshold, self.trees = threshold, trees
        self.lengths = depths(threshold, target, trees)
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = staged(in_arrow(docs, _signed(self.lengths, shingle, trees), f"doc_id {kind}, node binary, n_shingles long, keys array<long>, bits array<long>"), "shingle-nodes")
        self.members = rows.select("doc_id", "node")
        self.nodes = staged(rows.where("keys is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "forest")
        candidates = self._shared(len(self.lengths) - 1)  # who shares a longer prefix shares this one
        low = F.conv(F.hex(F.substring("node", 9, 8)), 16, -10).cast("long")
        wanted = docs.sparkSession.sparkContext.broadcast(hash_bits(candidates.select(low.alias("h")), "h"))
        sets = in_arrow(docs.select("text"), _sets(shingle, wanted), "node binary, hashes binary")
        self.sets = staged(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")

    def keyed(self, i: int) -> DataFrame:
        """(key, node, n) at the i-th prefix length."""
        return self.nodes.select("node", "n", F.explode(F.slice("keys", i * self.trees + 1, self.trees)).alias("key"))

    def _shared(self, i: int) -> DataFrame:
        """`keyed` where a key has several nodes, with its least one (pivot, pivot_n)."""
        rows = self.keyed(i)
        pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.min_by("n", "node").alias("pivot_n")).where("pivot != last")
        return rows.join(pivots.drop("last"), "key")

    def close(self, n: Column, m: Column) -> Column:
        """Whether set sizes allow the threshold."""
        return F.least(n, m) >= self.threshold * F.greatest(n, m) - 1e-9

    def stars(self, i: int) -> DataFrame:
        """Pairs (a, b) of each key's least node and its others."""
        return self._shared(i).where((F.col("node") != F.col("pivot")) & self.close(F.col("n"), F.col("pivot_n"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()

    def across(self, groups: DataFrame) -> DataFrame:
        """Pairs (a, b) that share a shortest prefix, in different groups, at most one of them in the key's largest."""
        rows = self._shared(len(self.lengths) - 1).select("key", "node", "n")
        rows = rows.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = rows.groupBy("key", "root").count()
        mixed = sizes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.count("root").alias("groups")).where("groups > 1").select("key", F.col("top.root").alias("main"))
        words = [F.coalesce(F.get("bits", F.lit(i)), F.lit(0)).alias(f"b{i}") for i in range(BITS // 64)]  # plain columns compile to tight code
        rows = staged(rows.join(mixed, "key").join(self.nodes.select("node", *words), "node"), "mixed-keys")
        outside = rows.where("root != main").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), *[F.col(f"b{i}").alias(f"x{i}") for i in range(len(words))])
        apart = (F.col("rx") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("x") < F.col("node")))
        differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"x{i}"))) for i in range(len(words))])
        most = (F.col("n") + F.col("nx") - differ) / 2  # in common, if only the differing bits tell the sets apart
        possible = most >= self.threshold * (F.col("n") + F.col("nx") - most) - 1e-9
        pairs = outside.join(rows, "key").where(apart & self.close(F.col("nx"), F.col("n")) & possible)
        return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets reach the threshold."""
        left = self.sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
        right = self.sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
        return in_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right"), _similar(self.threshold), "a binary, b binary")

    def _blocks(self, groups: DataFrame, least: int) -> DataFrame:
        """(root, lo, hi, slot, node, hashes), sorted: the nodes of groups with `least` and more, once for each slot of their group."""
        rows = groups.join(self.nodes.select("node", "n"), "node")
        many = F.ceil(F.greatest(F.count("n") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        sizes = rows.groupBy("root").agg(F.count("n").alias("nodes"), many.alias("slots")).where(F.col("nodes") >= least).drop("nodes")
        rows = rows.join(sizes, "root").withColumn("slot", F.pmod(F.xxhash64("node"), "slots").cast("int"))
        rows = rows.join(self.sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        rows = rows.select("root", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot", "node", "hashes")
        return rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def degrees(self, groups: DataFrame) -> DataFrame:
        """(node, n_links): the links of each node of `groups`, all of which are inside its group."""
        found = in_arrow(self._blocks(groups, 3), _within(self.threshold, False), "node binary, n_links long")
        two = groups.groupBy("root").agg(F.count("node").alias("nodes"), F.array(F.min("node"), F.max("node")).alias("both")).where("nodes = 2")
        return found.unionByName(two.select(F.explode("both").alias("node"), F.lit(1).cast("long").alias("n_links"))).groupBy("node").agg(F.sum("n_links").alias("n_links"))

    def links(self, groups: DataFrame) -> DataFrame:
        """(a, b) with a < b: every link of the nodes of `groups`. Their number grows with the square of a group."""
        return in_arrow(self._blocks(groups, 2), _within(self.threshold, True), "a binary, b binary")


def no_links(spark: SparkSession) -> DataFrame:
    """An empty (a, b). Local rows would be read by Python workers of their own, which wait on for a minute."""
    return spark.range(0).select(F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = RECALL, shingle: int = SHINGLE, trees: int = TREES, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: a row per input row: doc_id, class_id (the least doc_id of the texts that
    links connect), n_links (links of its text to other texts, all of them), node (its
    set; rows with the same node are copies). links: (a, b) verified pairs of nodes, of
    each class as many as connect it and were found on the way; with `all_links`, every one.
    """
    docs = narrow(df, doc_id=id_col, text=text_col)
    forest = Forest(docs, threshold, target, shingle, trees)
    links = no_links(df.sparkSession)
    tested = links
    groups = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for i in range(len(forest.lengths)):
        new = forest.stars(i).join(tested, ["a", "b"], "left_anti")
        own = F.coalesce("root", "node")
        if i:  # what one group holds already needs no comparison
            new = (
                new.join(groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
                .join(groups.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
                .where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
                .select("a", "b")
            )
        new = staged(new, "pairs")
        tested = tested.unionByName(new)
        links = staged(links.unionByName(forest.verified(new)), "links")
        groups = components(links)
    rest = staged(forest.across(groups).join(tested, ["a", "b"], "left_anti"), "pairs")
    links = staged(links.unionByName(forest.verified(rest)), "links")
    groups = components(links)
    degree = forest.degrees(groups)
    firsts = forest.members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id")).join(groups, "node", "left").withColumn("root", own)
    class_ids = firsts.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = firsts.join(class_ids, "root").join(degree, "node", "left").select(F.col("node").alias("of"), "class_id", "n_links")
    classes = forest.members.join(named, F.col("node") == F.col("of"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.hex("node").alias("node")
    )
    return classes, forest.links(groups) if all_links else links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))[0]
