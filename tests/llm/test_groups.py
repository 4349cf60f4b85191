"""Near duplicates and the pipeline, against plain Python."""

import collections
import re

import pytest

from opsdelta.llm import jaccard_join as J
from opsdelta.llm.groups import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """{doc_id: least doc_id of its group}, comparing all that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        for k, n in collections.Counter(k for g in s for k in where[g] if k > i).items():
            if n >= 0.8 * (len(s) + len(sets[k]) - n) - 1e-9:
                a, b = sorted((find(i), find(k)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_rule():
    assert J.depths() == [8, 5] and J.recall(0.8, 5) >= J.RECALL > J.recall(0.8, 6)
    assert J.depths(0.95) == [8]


def near_copies(n, words=120):
    """A chain: each text differs from the last in one word, and from the first in many."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        base = [*base]
        base[(7 * i) % words] = f"x{i}"
        out.append(" ".join(base))
    return out


def test_join_equals_brute_force(spark, corpus, weird, empty):
    texts = list(corpus[1].items()) + list(enumerate(near_copies(40), 1000)) + [(2000, "A b"), (2001, "a, B!"), (2002, "a b c"), (2003, None), (2004, "")]
    got, links = J.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    rows = {r.doc_id: r for r in got.collect()}
    want = classes(texts)
    assert {i: r.class_id for i, r in rows.items()} == want
    assert rows[2000].class_id == rows[2001].class_id == 2000 and rows[2002].class_id == 2002 and rows[2003].n_links == 0
    assert {r.n_links > 0 for i, r in rows.items() if 1000 <= i < 1040} == {True} and links.count() == links.distinct().count()
    odd = J.jaccard_join(weird)[0].collect()
    assert len(odd) == weird.count() and {r.class_id for r in odd if r.doc_id == 6} == {5}
    assert J.jaccard_join(empty)[0].count() == 0


def test_a_large_group_costs_few_comparisons(spark):
    base = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join([*base[: i % 150], f"x{i}", *base[i % 150 + 1 :]])) for i in range(600)] + [(i, " ".join(base)) for i in range(600, 900)]
    got, links = J.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert {r.class_id for r in got.collect()} == {0}
    assert links.count() < 600 * 20  # of 180,000 pairs


def test_links_inside_a_group_are_all_counted(spark, monkeypatch):
    def linked(rows):
        sets = {i: shingles(t) for i, t in rows}
        near = lambda s, t: len(s & t) >= 0.8 * len(s | t) - 1e-9
        return {(i, k) for i in sets for k in sets if i < k and sets[i] != sets[k] and near(sets[i], sets[k])}

    base = [f"w{i}" for i in range(60)]
    three = [" ".join([*base, end]) for end in ("a", "b", "c")]
    texts = list(enumerate([*three, *near_copies(90), "p q r s t u", "p q r s t u v", "alone it stands here in the corpus"]))
    want = linked(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for block in (J.BLOCK, 7):  # one block a group, and many
        monkeypatch.setattr(J, "BLOCK", block)
        got, links = J.jaccard_join(docs, all_links=True)
        rows = {r.doc_id: r for r in got.collect()}
        assert [rows[i].n_links for i in range(3)] == [2, 2, 2]
        assert {i: r.n_links for i, r in rows.items()} == {i: sum(i in pair for pair in want) for i, _ in texts}
        ids = {r.node: i for i, r in rows.items()}
        pairs = [tuple(sorted((ids[r.a.hex().upper()], ids[r.b.hex().upper()]))) for r in links.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline as P

    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in corpus[0].collect()]
    n = len(rows)
    extra = [None, "12 34 !!", rows[0][1], *near_copies(5)]
    bench = [(1, "zz " + " ".join(f"bench{i}" for i in range(20)))]
    extra.append(" ".join(f"bench{i}" for i in range(20)) + " the end of it")
    rows += [(n + i, t, "en", "s", 0) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, corpus[0].schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in P.STAGES:
        left = P.staged(stage(spark, left, str(tmp_path)), "test-stage")
        ids.append({r.doc_id for r in left.select("doc_id").collect()})
        if name != P.STAGES[-1][0]:
            assert left.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    assert {n, n + 1} & ids[0] == set() and ids[0] >= set(range(n))
    newest = {text[i]: i for i in sorted(ids[0])}
    assert ids[1] == set(newest.values()) and 0 not in ids[1]
    group = classes([(i, text[i]) for i in sorted(ids[1])])
    assert ids[2] == {i for i in ids[1] if group[i] == i}
    assert n + len(extra) - 1 in ids[2] and ids[3] == ids[2] - {n + len(extra) - 1} == ids[4]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == ids[4]
    assert P.ORACLE_SQL is None and "op5_jaccard_join" in __import__("__spark_entry__").queries()


@pytest.mark.parametrize("k", range(5))
def test_a_stage_alone_hands_over_small_batches(spark, tmp_path, k):
    import corpus_pipeline as P

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "n_bytes"])

    spark.createDataFrame([(1, "no such passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "one two", "en"), (2, "three four", "en")], "doc_id long, text string, lang string")
    for key in P.BATCHES:
        spark.conf.unset(key)
    out = P.STAGES[k][1](spark, docs, str(tmp_path))
    short, long = (spark.range(0, 6000, 1, 1).selectExpr("id", f"repeat('x', {n}) as text").mapInArrow(sizes, "n long, n_bytes long") for n in (10, 10_000))
    assert sum(r.n for r in short.collect()) == 6000 and max(r.n for r in short.collect()) <= 1000
    assert sum(r.n for r in long.collect()) == 6000 and max(r.n_bytes for r in long.collect()) < 5 << 20
    assert {r.doc_id for r in out.collect()} == {1, 2}


def test_no_links_need_no_python(spark):
    empty = J.no_links(spark)
    assert empty.dtypes == [("a", "binary"), ("b", "binary")] and empty.count() == 0
    assert "ExistingRDD" not in empty._jdf.queryExecution().toString()


def test_sources_keep_house_rules():
    import glob
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in [*glob.glob(f"{root}/opsdelta/llm/*.py"), f"{root}/corpus_pipeline.py"]:
        with open(path) as f:
            text = f.read()
        assert not re.search(r"localCheckpoint|\.toPandas\(|F\.udf\(|crossJoin|except ImportError|ModuleNotFound|\.limit\(|\.sample\(", text), path
    for base, _, names in os.walk(f"{root}/opsdelta"):
        for name in names:
            if name.endswith(".py") and not base.endswith("/llm"):
                with open(f"{base}/{name}") as f:
                    assert "llm" not in f.read(), name


@pytest.mark.parametrize("name", ["op8_decontaminate", "op9_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    from harness import compare, duck

    from opsdelta.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name]) is None
