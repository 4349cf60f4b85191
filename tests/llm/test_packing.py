"""Packing, fill-in-the-middle and hard negatives, against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from opsdelta.llm import fill_in_middle as fim
from opsdelta.llm import hard_negatives as hard
from opsdelta.llm import packing, word_ids


def padding(n, window):
    return 0 if n & (n - 1) == 0 else window - n


def cheapest(places, penalties, window):
    """Cost and number of sequences of the best cuts, every pair of places tried."""
    best = [(0, 0)]
    for j in range(1, len(places)):
        ways = [(best[i][0] + padding(places[j] - places[i], window) + penalties[j], best[i][1] + 1) for i in range(j) if places[j] - places[i] <= window]
        best.append(min(ways))
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rnd = np.random.default_rng(seed)
    window = int(rnd.choice([8, 32, 100]))
    doc_ends = np.cumsum(rnd.integers(1, 3 * window if seed % 2 else window, rnd.integers(1, 25)))
    sentence_ends = np.unique(rnd.integers(1, doc_ends[-1] + 1, rnd.integers(0, 40)))
    places, penalties = packing.candidates(doc_ends, sentence_ends, gap=max(2, window // 4), sentence=int(rnd.integers(0, 20)), inside=int(rnd.integers(0, 60)))
    assert places[0] == 0 and places[-1] == doc_ends[-1] and np.diff(places).max() <= window
    cuts = packing.choose(places, penalties, window)
    assert cuts[0] == 0 and cuts[-1] == len(places) - 1
    sizes = np.diff(places[cuts])
    assert sizes.max() <= window
    cost = sum(padding(int(n), window) for n in sizes) + int(penalties[cuts[1:]].sum())
    assert (cost, len(sizes)) == cheapest(places.tolist(), penalties.tolist(), window)


def test_candidates_are_document_ends_sentence_ends_and_places_in_long_sentences():
    places, penalties = packing.candidates(np.array([10, 1000]), np.array([4, 10, 500]), gap=200, sentence=3, inside=9)
    assert places.tolist() == [0, 4, 10, 210, 410, 500, 700, 900, 1000]
    assert penalties.tolist()[1:] == [3, 0, 9, 9, 3, 9, 9, 0]


def library_ids(texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return [[*e.ids, packing.END_ID] for e in Tokenizer.from_file(path("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(df):
    from public_tokenizers import path

    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted((repr(i), ids) for (i, _), ids in zip(rows, library_ids([t for _, t in rows])))
    pieces = packing.pack_documents(df, path("word_bpe_49k.json")).collect()
    by_sequence, got, documents = {}, [], {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    order, total, padded = [], 0, 0
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            order.append(r)
        assert at <= packing.WINDOW
        total, padded = total + at, padded + padding(at, packing.WINDOW)
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    ids = []
    for r in order:  # pieces in the order of the stream rebuild the documents
        assert r.start == len(ids)
        ids += np.frombuffer(r.ids, dtype="<u4").tolist()
        if len(ids) == r.doc_tokens:
            got.append((repr(r.doc_id), ids))
            ids = []
    assert not ids and sorted(got) == want
    return total, padded


def test_packing_keeps_every_id_once_and_in_order(spark, weird, empty, corpus):
    check_packing(weird)
    total, padded = check_packing(corpus[0])
    assert padded < 0.01 * total
    assert check_packing(empty) == (0, 0)


def test_packing_does_not_depend_on_the_size_of_tasks(spark, weird, corpus, monkeypatch):
    monkeypatch.setattr(packing, "TASK", 1 << 14)
    check_packing(weird)
    total, padded = check_packing(corpus[0].union(corpus[0]))
    assert padded < 0.06 * total  # each of 22 tasks ends with a shorter sequence


def test_sentences_of_the_tokenizer_join_to_the_ids_of_the_text(corpus):
    from public_tokenizers import path

    texts = [*corpus[1].values(), "A b. C d! e?\n\nf 3.14 x.y it's", "a. <|endoftext|> b. c", "ΑΣ. ΣΑΣ x", ".  . . \t\r ! ", "é. a", "²½ 1٣ _a_ 東京。京"]
    encoder = word_ids.encoder(path("word_bpe_49k.json"))
    want = [np.array(i[:-1], dtype="<u4").tobytes() for i in library_ids(texts)]
    assert encoder.encode(texts) == want
    assert [b"".join(p) for p in encoder.encode_sentences(texts)] == want
    assert len(encoder.encode_sentences(["A b. C d! e?\nf 3.14"])[0]) == 4


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, len(units), form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m)


def test_fill_in_middle_equals_plain_python_and_is_undone(spark, weird, empty, corpus):
    odd = [(100 + i, t) for i, t in enumerate(["<P> a", "x <S>", "a <M> b", "<P a S> M>", " \x0b\x0c lead", "tail \t ", "$1 \\ {2}+ $", " 　\x85 x", "😀 a 😀😀 b\n"] * 12)]
    odd = spark.createDataFrame(odd + [(999, "a b\n" * 300_000)], "doc_id long, text string")
    for df in (weird, corpus[0], odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        done = fim.restore(fim.fill_in_middle(df)).collect()
        assert sorted([tuple(r)[:6] for r in done], key=repr) == sorted([plain_fim(*r) for r in rows], key=repr)
        assert sorted(r.restored for r in done) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(empty).count() == 0
    assert {r.form for r in fim.fill_in_middle(odd).collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_takes_other_seeds_and_rates(spark, corpus):
    assert {r.form for r in fim.fill_in_middle(corpus[0], rate=0).collect()} == {"plain"}
    assert "psm" not in {r.form for r in fim.fill_in_middle(corpus[0], rate=100, spm_rate=100).collect()}
    assert fim.fill_in_middle(corpus[0], seed=7).select("output").exceptAll(fim.fill_in_middle(corpus[0]).select("output")).count() > 0


def plain_negatives(rows, k=5, low=80):
    known = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    known = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in known]
    out = []
    for a, label, q in {(i, y, tuple(v)) for i, y, v in known if i % 100 == 0}:
        scored = sorted((-sum(x * z for x, z in zip(q, v)), i, y) for i, y, v in known if i != a and len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            fit = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fit)]
    return sorted(out)


def vectors(n, d, seed, labels=10, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, d))
    y = rnd.integers(0, labels, n)
    x = centres[y] * spread + rnd.normal(size=(n, d))
    return [(int(i), [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 4), y))]


def mined(spark, rows, **how):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"block": F.lit(1), "key": F.lit("x"), "windows": F.lit(0)})
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard.hard_negatives(df.repartition(3), F.col("vec_id") % 100 == 0, label=moved, **how).collect())


def floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("case", ["plain", "low dimension", "ties", "few"])
def test_hard_negatives_equal_every_score_tried(spark, monkeypatch, case):
    monkeypatch.setattr(hard, "BLOCK", 300)
    rows = {
        "plain": lambda: vectors(1500, 16, 1),
        "low dimension": lambda: vectors(2500, 2, 2, labels=3),
        "ties": lambda: [(i, [round(x) / 4 for x in v], y % 3) for i, v, y in vectors(900, 4, 3)],
        "few": lambda: vectors(9, 8, 4),
    }[case]()
    assert mined(spark, rows) == plain_negatives(floats(rows))


def test_hard_negatives_on_odd_rows(spark):
    rows = vectors(400, 6, 5, labels=4)
    rows[3] = (3, None, 1)
    rows[4] = (4, [1.0] * 5 + [None], 1)
    rows[5] = (5, [1.0] * 5 + [float("nan")], 1)
    rows[6] = (6, [1.0] * 5 + [float("-inf")], 1)
    rows[8], rows[9], rows[10] = (8, [1.0] * 6, None), (9, [], 2), (None, [1.0] * 6, 2)
    rows[100] = (100, [0.0] * 6, 1)
    rows[200] = (200, [], 2)
    rows += [rows[0], rows[0], rows[7], (21, [2.0, 1.0], 1), (300, [1.0, 1.0], 1), (22, [1.0, 1.5], 2), (23, [40.0, 40.0], 1)]
    got = mined(spark, rows)
    assert got == plain_negatives(floats(rows)) and {0, 100, 300} <= {r[0] for r in got}
    assert mined(spark, rows[:0]) == []


def test_hard_negatives_stop_before_they_read_every_row():
    rnd = np.random.default_rng(0)
    block = hard.Block(np.arange(20_000), np.zeros(20_000, np.int64), rnd.integers(-128, 128, (20_000, 3)))
    read = []
    scores = block.scores
    block.scores = lambda rows, anchor: read.append(len(rows)) or scores(rows, anchor)
    anchor = np.array([100, -50, 20])
    [(s, i)] = block.best(anchor, 0, 20_000, np.ones(20_000, bool), np.array([-hard._DONE]), np.array([hard._DONE]), 5)
    every = block.vectors @ anchor
    assert sum(read) < 10_000
    assert list(zip(s.tolist(), i.tolist())) == sorted(zip(every.tolist(), range(20_000)), key=lambda x: (-x[0], x[1]))[:5]


def test_pieces_carry_their_crc(spark):
    import json

    got = packing.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = dict(zip(texts, library_ids(list(texts.values()))))
    for r in got.collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part), len(ids[r.doc_id])), json.dumps(r.asDict())


def test_sentences_are_not_asked_again_what_holds_for_their_text(monkeypatch):
    from public_tokenizers import path

    encoder = word_ids.Encoder(path("word_bpe_49k.json"))
    texts = ["Don't stop. ΑΣ ΟΔΟΣ! İstanbul? Next Line\nA b. c. Ünï 3.14", "One Two. three Four! 5 six?\nSEVEN", "<|endoftext|> a. B", "éa. B c"]
    for text in texts:
        parts = word_ids._sentence_parts(text)
        assert [x for p in parts for x in p] == (word_ids._parts(text) if len(parts) == 1 else [x for s in re.split(r"(?<=[.!?]) |\n", text) for x in word_ids._parts(s)])
    assert [b"".join(p) for p in encoder.encode_sentences(texts)] == encoder.encode(texts)
    encoder.encode_sentences(["one two. " * 50])
    asked, plain = [], word_ids._whole
    monkeypatch.setattr(word_ids, "_whole", lambda t: asked.append(t) or plain(t))
    encoder.encode_sentences(["one two. " * 50])
    assert len(asked) == 1


def test_sentences_of_known_words_are_joined_without_a_search(monkeypatch):
    from public_tokenizers import path

    encoder, texts = word_ids.Encoder(path("word_bpe_49k.json")), ["One two. Three!\nfour  five", "", "don't <|endoftext|> a b"]
    first = encoder.encode_sentences(texts)
    assert [len(x) for x in first] == [3, 1, 1] and [b"".join(x) for x in first] == encoder.encode(texts)
    monkeypatch.setattr(encoder, "_known", None)
    assert encoder.encode_sentences(texts) == first


def test_marks_stand_where_sentences_end(monkeypatch):
    from public_tokenizers import path

    encoder = word_ids.Encoder(path("word_bpe_49k.json"))
    texts = ["One two. Three!\nfour  five,", "", "\n", "a.\n\n b", "don't <|endoftext|> a. b", "Don't. ΑΣ ΟΔΟΣ! 3.14, (x)? Ünï, y", "²½ _a_ 東京。京"]
    for limit in (word_ids.CACHED, 0):  # a cache of no size starts anew with every call
        monkeypatch.setattr(word_ids, "CACHED", limit)
        assert encoder.encode_marked(texts) == [word_ids.MARK.join(x) for x in encoder.encode_sentences(texts)]
        assert [x.replace(word_ids.MARK, b"") for x in encoder.encode_marked(texts)] == encoder.encode(texts)
    want = [np.array(i[:-1], dtype="<u4").tobytes() for i in library_ids(texts)]
    assert encoder.encode(texts) == want
