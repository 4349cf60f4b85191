"""Language, quality and toxicity: brute force for the searches, held-out accuracy for the models."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsdelta.llm import arrays as A
from opsdelta.llm import language, quality, toxicity
from opsdelta.llm.language import fold
from opsdelta.llm.samples import labelled_sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def best(scores, switch):
    return max(sum(s[k] for s, k in zip(scores, path)) - switch * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(scores.shape[1]), repeat=len(scores)))


def test_viterbi_equals_brute_force():
    random = np.random.default_rng(4)
    for _ in range(40):
        sizes = random.integers(0, 7, 5)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = random.normal(0, 3, (first[-1], 3)).astype(np.float32)
        labels = language.viterbi(scores, first, 2.5)
        for a, b in zip(first[:-1], first[1:]):
            path, s = labels[a:b].tolist(), scores[a:b]
            mine = sum(x[k] for x, k in zip(s, path)) - 2.5 * sum(p != q for p, q in zip(path, path[1:]))
            assert mine == pytest.approx(best(s, 2.5) if len(s) else 0, abs=1e-4)


def test_trigrams_stay_inside_words():
    one, many = (A.slices(pa.array(x)) for x in (["abc"], ["xx", "", "abc.abc ", "abc"]))
    _, _, d1, o1 = next(one)
    _, _, d2, o2 = next(many)
    want, _ = language.trigrams(d1, A.words(d1, o1))
    got, first = language.trigrams(d2, A.words(d2, o2))
    assert [got[a:b].tolist() for a, b in zip(first[:-1], first[1:])][1:] == [want.tolist()] * 3


def test_scripts_are_those_of_the_first_character_that_has_one():
    numbers = {n: i for i, n in enumerate(language._NAMES)}
    texts = ["2nd 42 99日本 «Слово» ෴සිංහල ខ្មែរ ລາວ x1 “quoted” 7", None, "", "ଓଡ଼ିଆ 1—2 3é " + "4" * 5000 + "b"]
    _, _, data, offs = next(A.slices(pa.array(texts)))
    w = A.words(data, offs)
    for a, b, found in zip(w.starts, w.ends, language.scripts(data, w)):
        named = (numbers[n] for c in bytes(data[a:b]).decode() for n, low, high in language.SCRIPTS if low <= ord(c) <= high)
        assert found == next(named, 0), bytes(data[a:b])


def test_word_scores_equal_plain_sums_over_many_languages():
    random = np.random.default_rng(5)
    words = ["".join(random.choice(list("abcdefghij"), 5)) for _ in range(300)]
    langs = [f"l{i:02}" for i in range(2 * language.BLOCK + 3)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(random.choice(words, 40)) for _ in langs], "lang": langs})
    model = language.Model(pa.Table.from_batches(list(language._counts(iter([batch])))))
    _, _, data, offs = next(A.slices(pa.array(["abcde 12 fghij jjjaa"])))
    w = A.words(data, offs)
    got = model.word_scores(data, w)
    buckets, first = language.trigrams(data, w)
    for i in range(len(w.starts)):
        raw = sum(model.scores[b].astype(float) for b in buckets[first[i] : first[i + 1]])
        lettered = bytes(data[w.starts[i] : w.ends[i]]).isalpha()
        assert np.allclose(got[i], np.clip(raw - raw.mean(), -language.LIMIT, language.LIMIT) if lettered else 0.0, atol=1e-4)


def test_language_in_a_script_of_its_own_and_behind_digits(spark):
    rows = [("සිංහල භාෂාව ලංකාව", "si"), ("the quick brown fox", "en"), ("ພາສາລາວ ປະເທດ", "lo")] * 5
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = [(1, "2භාෂාව 3සිංහල"), (2, "9ພາສາລາວ"), (3, "1quick 2fox")]
    got = language.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "si", 2: "lo", 3: "en"}


def test_a_sample_has_no_more_rows_than_ids(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (4, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 100).select("text", "label").collect()
    assert sorted(tuple(r) for r in rows) == [("", 0), ("copy 0", 1)]


def test_language(spark, docs, weird, empty):
    model = language.fitted(docs)
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", fold("doc_id", 5) == 0)
    assert rows.where("held").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    texts = {r.lang: r.text for r in docs.where("length(text) > 3000").collect()}
    mixed = " ".join(texts["en"].split()[:150]) + " " + " ".join(texts["de"].split()[:100])
    r = language.predict(spark.createDataFrame([(1, mixed), (2, "12 34"), (3, "日本語 だけ")], "doc_id long, text string"), model).collect()
    spans = r[0].spans
    assert r[0].lang_pred == "en" and [s.lang for s in spans] == ["en", "de"] and abs(spans[1].first_word - spans[0].end_word) == 0 and abs(spans[0].end_word - 150) <= 8
    assert (r[1].lang_pred, r[1].score) == ("und", 0.0) and r[2].lang_pred in model.languages
    odd = language.predict(weird, model).collect()
    assert len(odd) == weird.count() and {x.lang_pred for x in odd if x.doc_id in (1, 2, 3, 4)} == {"und"} and all(0 <= x.score <= 1 for x in odd)
    assert language.predict(empty, model).count() == 0
    none = language.train(docs.where("false"))
    assert {x.lang_pred for x in language.predict(weird, none).collect()} == {"und"}


def test_folds_are_crc32_of_the_text_of_the_id(docs):
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.h for r in docs.select("doc_id", (fold("doc_id", 5) == 0).alias("h")).collect())


def test_log_ratios_and_dual_descent_find_the_margin():
    random = np.random.default_rng(5)
    rows = [np.unique(np.concatenate([random.integers(0, 50, 12), [60] if i % 2 else [61]])) for i in range(200)]
    y = np.array([1 if i % 2 else -1 for i in range(200)])
    ratios = quality.log_ratios(rows, y)
    assert ratios[60] > 3 and ratios[61] < -3
    w, b = quality.dual_descent(rows, y, ratios)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, y))


def test_features_do_not_depend_on_slices():
    texts = ["The the the cat | sat!! ", "", "Ünï 42, 42.", "X" * 3000, "The the the cat | sat!! "]
    got = {}
    for target in (1, 1 << 20):
        for lo, hi, data, offs in A.slices(pa.array(texts), target):
            for i, f in enumerate(quality._per_text(data, offs)):
                assert got.setdefault(texts[lo + i], f.tolist()) == f.tolist()
    assert got[""] == []


def test_quality(spark, docs, labels, weird, empty):
    model = quality.fit(docs, labels, "quality", fold("doc_id", 5) != 0)
    rows = quality.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    odd = quality.score(weird, model).collect()
    assert len(odd) == weird.count() and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    assert quality.score(empty, model).count() == 0
    assert quality.fit(docs, labels.where("false"), "quality", F.lit(True)).share == 0.5
    short = quality.fit(docs, labels.where("quality = 1"), "quality", F.lit(True))
    assert {r.score for r in quality.score(weird, short).collect()} == {1.0}


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        w = A.Words(np.arange(n), np.arange(n) + 1, np.zeros(n, np.uint64), np.array([0, n]))
        text, start, length = toxicity.windows(w)
        assert len(text) == (0 if n == 0 else 1 if n <= 32 else 1 + -(-(n - 32) // 16))
        assert set().union(*[range(s, s + k) for s, k in zip(start, length)]) == set(range(n)) if n else not len(text)


def test_gradients_equal_finite_differences():
    features, index, live = toxicity._tensor(["alpha beta gamma alpha", "delta", "beta delta epsilon"])
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradients(features, index, live, y, weight)
    for name in ("uf", "ub", "wf", "cb", "af", "ob", "bias", "word", "seven"):
        grad, where = (g[name][1], g[name][0]) if isinstance(g[name], tuple) else (g[name], None)
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        spot = (where[at[0]], *at[1:]) if where is not None else at
        old, values = net.p[name][spot], []
        for step in (1e-4, -1e-4):
            net.p[name][spot] = old + step
            values.append(net.gradients(features, index, live, y, weight)[0])
        net.p[name][spot] = old
        assert (values[0] - values[1]) / 2e-4 == pytest.approx(grad[at], rel=0.03, abs=2e-5), name


def test_scores_do_not_depend_on_slices_and_see_the_end():
    texts = ["good words " * 40 + "bad", "good words " * 40, "bad", ""]
    lifts = np.zeros(3 * toxicity.TABLE, np.float32)
    windows = ["good words " * 16, "bad good words " * 10, "words good " * 16, "words bad good " * 10] * 20
    net = toxicity.learn(windows, np.array([0, 1, 0, 1] * 20), np.arange(80), lifts)
    model = toxicity.Model(net, 0.5)
    whole = model.logits(*next(A.slices(pa.array(texts)))[2:])
    each = [model.logits(data, offs)[0] for _, _, data, offs in A.slices(pa.array(texts), 1)]
    assert np.allclose(whole, each, atol=1e-4) and whole[0] > whole[1] and np.isneginf(whole[3])


def test_toxicity(spark, docs, labels, weird, empty):
    model = toxicity.fit(docs, labels, "toxic", fold("doc_id", 3) != 1)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1).collect()
    bad, good = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.75  # few toxic rows to learn from at this size
    odd = toxicity.score(weird, model).collect()
    assert len(odd) == weird.count() and all(0 <= r.score <= 1 for r in odd) and {r.score for r in odd if r.doc_id in (1, 2, 3, 4)} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.fit(docs, labels.where("false"), "toxic", F.lit(True))
    assert {r.score for r in toxicity.score(weird, flat).collect()} == {0.5}


def test_language_labels_many_slices_together(monkeypatch):
    """Steps of Viterbi are shared by the texts of a batch, and no text's labels depend on its neighbours."""
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["kwik", "zwak", "vlak"]}
    random = np.random.default_rng(3)
    texts = [" ".join(random.choice(words["aa" if (i + j // 40) % 2 else "bb"], 1)[0] for j in range(n)) for i, n in enumerate([30_000, 0, 90, 200, 50_000, 1, 40_000, 300])]
    taught = pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in words.values()]), pa.array(list(words))], names=["text", "lang"])
    model = language.Model(pa.Table.from_batches(list(language._counts(iter([taught])))).select(["lang", "kind", "at", "n"]))
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows), pa.array([texts[i] for i in rows]), pa.array([bool(texts[i]) for i in rows])], names=["doc_id", "text", "has_letter"])
    calls, plain = [], language.viterbi
    monkeypatch.setattr(language, "viterbi", lambda *a: calls.append(len(a[0])) or plain(*a))
    run = language._predicted(type("Shared", (), {"value": model}), language.SWITCH, True)
    got = [r for b in run(iter([batch(list(range(len(texts))))])) for r in b.to_pylist()]
    assert len(calls) == 1 and len(list(A.slices(pa.array(texts)))) > 2
    assert got == [r for i in range(len(texts)) for b in run(iter([batch([i])])) for r in b.to_pylist()]
    assert len(got[0]["spans"]) > 2
    monkeypatch.setattr(language, "HELD", 1)
    assert got == [r for b in run(iter([batch(list(range(len(texts))))])) for r in b.to_pylist()]


def test_workers_give_back_memory_after_a_task(monkeypatch):
    from opsdelta.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common._then_give_back(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and given == [1]
