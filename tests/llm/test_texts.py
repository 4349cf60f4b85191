"""Operators that return facts of whole texts, against plain Python."""

import collections
import hashlib
import os
import re

import numpy as np
import pytest

from opsdelta.llm import arrays as A
from opsdelta.llm import decontaminate, exact_dedup, license_scan, pieces, secret_scan, token_files

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_array_words_and_shingles_equal_plain_python():
    import pyarrow as pa

    texts = ["One two  three", None, "", "éa-b", "four", "A" * 5000 + " b", "x,y;z 1 2 3 4 5 6"]
    for target in (1, 10, 1 << 20):
        found, by_text = {}, []
        for lo, hi, data, offs in A.slices(pa.array(texts), target):
            w = A.words(data, offs)
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                got = [A.LOWER[data[s:e]].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])]
                by_text.append(got)
                for x, h in zip(got, w.hashes[a:b]):
                    assert found.setdefault(x, h) == h
            at, h = A.ngrams(w, 3)
            assert len(at) == sum(max(0, len(words(t)) - 2) for t in texts[lo:hi])
        assert by_text == [words(t) for t in texts] and len(set(found.values())) == len(found)


def dedup(rows):
    size, top = collections.Counter(t or "" for _, t in rows), {}
    for i, t in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    return sorted(((i, top[t or ""] if top[t or ""] >= 0 else None, size[t or ""], (i if i is not None else -1) == top[t or ""], sha(t or "")) for i, t in rows), key=repr)


def test_exact_dedup(spark, weird, empty, corpus):
    for df in (weird, corpus[0]):
        pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted([tuple(r) for r in exact_dedup.exact_dedup(df, digest_all=True).collect()], key=repr)
        assert got == dedup(pairs)
        plain = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
        assert plain == {x[:4] for x in got}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_reads_no_more_than_it_must(spark):
    texts = ["same length 1", "same length 2", "x" * 64 + "a", "x" * 64 + "b", "alone", "twice", "twice"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, texts)).collect()}
    assert [got[i].text_sha256 is not None for i in range(7)] == [False, False, True, True, False, True, True]
    assert [got[i].kept for i in range(7)] == [True] * 5 + [False, True]


def test_native_operators_run_no_python(spark, corpus):
    for df in (exact_dedup.exact_dedup(corpus[0]), license_scan.license_scan(corpus[0])[0], secret_scan.secret_scan(corpus[0])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def windows(benchmark):
    out = collections.defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out[tuple(w[i : i + n])].add(item)
    return out


def contaminated(text, found):
    w = words(text)
    hit, items = set(), set()
    for n in {len(k) for k in found}:
        for i in range(len(w) - n + 1):
            if (who := found.get(tuple(w[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                items |= who
    names = sorted(str(i) for i in items if i is not None)
    return len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, weird, empty, corpus):
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    found = windows(bench)
    table_ = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(corpus[0], table_).collect()}
    assert got == {i: contaminated(t, found) for i, t in corpus[1].items()} and any(r[4] for r in got.values())
    odd = [(1, "a"), (1, "the the"), (2, "the the"), (3, None), (4, ""), (None, "ctrl tab"), (5, " ".join(f"w{i}" for i in range(20))), (6, "word " * 13)]
    table_ = spark.createDataFrame([(*x, 5) for x in odd], "item_id long, text string, words int")
    found = windows(odd)
    expected = sorted((r.doc_id, *contaminated(r.text, found)) for r in weird.collect() if r.doc_id is not None)
    assert sorted(tuple(r) for r in decontaminate.decontaminate(weird, table_).collect() if r.doc_id is not None) == expected
    assert decontaminate.decontaminate(empty, table_).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(weird, table_.where("false")).collect()} == {0}


def licences(text):
    w, places, labels = words(text), [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, weird, empty, corpus):
    texts = list(corpus[1].values()) + [
        "CC-BY cc by, CC\nBY 4", "All rights RESERVED. all rights reserved all rights", "general public", "the GNU General Public License", "cc é by",
        "Permission is hereby granted, free of charge, to any nice person obtaining a copy of this software and associated documentation files",
        "Released under the M.I.T license", "cc " * 50_000 + "by", "İcc by K",
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, texts))[0].collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licences(t), t[:80]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[len(texts) - 4].labels == "mit"  # a word more than the template: two diagonals, one span
    spans = license_scan.license_scan(table(spark, texts))[1].where(f"label = 'mit' and doc_id = {len(texts) - 4}").collect()
    assert [(s.first_word, s.end_word) for s in spans] == [(0, 21)]
    assert license_scan.license_scan(weird)[0].count() == weird.count() and license_scan.license_scan(empty)[0].count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(s)


def random_hex(n, seed):
    return hashlib.shake_256(str(seed).encode()).hexdigest(n)


def test_secret_scan(spark, weird, empty, corpus):
    key = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[b % 62] for b in hashlib.shake_256(b"k").digest(60))
    texts = list(corpus[1].values()) + [
        "token = 'abc' token: abcdef", "token=token:abcdefg", "👩é PASSWORD = \"hunter22\" and Api_Key:xyz-1234", "AKIA" + "Z9" * 8 + " AKIA" + "Q" * 15,
        "f" * 23 + " " + "0123456789abcdef" * 2, "secret==== a", "password" * 20_000, "key " + key + " end", "a " + random_hex(20, 1).upper() + " b",
        "see page_1/section_2/page_1/section_2/page_1", "aaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaaaaaaaaaa", "",
    ]
    rows = {r.doc_id: r for r in secret_scan.secret_scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = secrets(t)
        assert [tuple(s) for s in rows[i].base_spans] == base, t[:60]
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        assert set(rows[i].base_spans) <= set(rows[i].all_spans)
    n = len(texts)
    assert [(s.start, s.end) for s in rows[n - 5].all_spans] == [(4, 64)] and rows[n - 4].n_random == 1
    assert rows[n - 3].n_random == rows[n - 2].n_random == 0
    assert secret_scan.secret_scan(weird).count() == weird.count() and secret_scan.secret_scan(empty).count() == 0


def test_secrets_glued_to_names_and_paths(spark):
    def random(alphabet, n, seed):
        return "".join(alphabet[b % len(alphabet)] for b in hashlib.shake_256(seed).digest(n))

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = capitals + capitals.lower() + "0123456789"
    aws, key, urlsafe = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY1", random(plain, 40, b"k"), random(plain + "-_", 44, b"u")
    texts = [
        (f"AWS_SECRET_ACCESS_KEY={aws}", aws), (f"👩 https://x.org/?client_id={key}&n=1", key), (f"?sig={random(plain + '+/', 42, b's')}== end", random(plain + "+/", 42, b"s") + "=="),
        (f"GET /my-app/{urlsafe} now", urlsafe), (f"a={key}=b", key), ("otp " + random(capitals, 32, b"o") + " end", random(capitals, 32, b"o")),
        ("first_name=second_name=third_name4", None), ("/my-app/section-2/page_3/my-app/section-2", None),
    ]
    rows = {r.doc_id: r for r in secret_scan.secret_scan(table(spark, [t for t, _ in texts])).collect()}
    assert len(rows) == len(texts)
    for i, (text, secret) in enumerate(texts):
        found = [text[s.start : s.end] for s in rows[i].all_spans]
        assert len(found) == (secret is not None) and (not found or found[0].endswith(secret)), (text, found)
    assert rows[0].all_spans[0].start == len("AWS_SECRET_ACCESS_KEY=")


def test_battery_calls_random_tokens_random(spark):
    rows = [(random_hex(20, i), True) for i in range(200)] + [(("ab12" * 10)[i % 4 :][:36], False) for i in range(40)]
    tested = secret_scan.ordinary(secret_scan.battery(spark.createDataFrame(rows, "token string, random boolean")))
    wrong = {(r.random, r.ordinary) for r in tested.collect()}
    share = tested.where("random and ordinary").count() / 200
    assert (False, False) not in wrong and share <= 0.05


NAMES = """getUserAccountById2 camelCaseIdentifier42 configuration_file_2020 src/main/java/App1 thumbnail_1280x720_final
COVID19VaccinationRecord 1234567890abcdef12 SUPERCALIFRAGILISTIC my-long-branch-name/feature-142 INTERNATIONALIZATION
node_modules/lodash4/index user_profile_picture_v2 2021-03-04T10-20-30Z abcdefghijklmnop1 HttpServletRequest2Wrapper
reports/2023/quarter4/summary thisIsAVeryLongMethodName1 0000000000000000a release-candidate-2024-11-30 Section12Paragraph34Item5""".split()


def random_token(alphabet, n, seed):
    r = np.random.default_rng(seed)
    while True:
        token = "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))
        if re.search("[0-9]", token) and re.search("[A-Za-z]", token):
            return token


def like_text(token):
    """The p-value of ordinary text, symbol by symbol."""
    letters = [x / sum(secret_scan._LETTERS) for x in secret_scan._LETTERS]
    core = token.rstrip("=")
    size = next(len(a) for _, pattern, a in secret_scan.ENCODINGS if re.match(pattern, core))
    bits, before = 0.0, None
    for c in core:
        k = next(k for k, symbols in enumerate(secret_scan._SYMBOLS) if c in symbols)
        i = secret_scan._SYMBOLS[k].index(c)
        q = letters[i] if k < 2 else (0.1 if k == 2 else 0.25)
        if before is None:
            chance = secret_scan._FIRST[k] * q
        elif before[0] == k:
            chance = secret_scan._NEXT[k][k] * ((1 - secret_scan._STEP) * q + (secret_scan._STEP / 2 if i - before[1] in (0, 1) else 0))
        else:
            chance = secret_scan._NEXT[before[0]][k] * q
        bits += np.log2(chance) + np.log2(size)
        before = k, i
    return min(1.0, len(secret_scan.ENCODINGS) * 2.0 ** min(0.0, bits))


def test_names_are_not_reported_and_random_tokens_are(spark):
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kinds = [plain + "+/", plain, "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    keys = [random_token(kinds[i % 4], 24 + i % 30, i) for i in range(400)]
    for texts in ([f"see {t} here" for t in keys + NAMES for _ in range(3)], [f"see {t} here" for t in NAMES]):
        found = secret_scan.secret_scan(table(spark, texts)).where("n_random > 0").select("doc_id").collect()
        tokens = [texts[r.doc_id].split()[1] for r in found]
        assert not set(tokens) & set(NAMES)
        assert len(texts) < 100 or len(tokens) >= 0.98 * 3 * len(keys)


def test_control_of_false_reports_equals_plain_python(spark):
    tokens = [random_token("abcdefghijklmnopqrstuvwxyzABC0123456789", 16 + i % 50, i) for i in range(80)] + NAMES + ["a1" * 12, "Ab3=" * 4 + "x" * 8]
    rows = secret_scan.ordinary(secret_scan.battery(spark.createDataFrame([(t,) for t in tokens if "=" not in t and not re.search("[+/].*[_-]|[_-].*[+/]", t)], "token string"))).collect()
    groups = {}
    for r in rows:
        assert np.isclose(r.p_text, like_text(r.token), rtol=1e-6)
        p = 10 ** (-min(secret_scan.DEEPEST, np.floor(-np.log10(max(r.p_text, 1e-300)) * secret_scan.STEPS)) / secret_scan.STEPS)
        groups.setdefault((r.encoding, int(np.log2(r.n))), []).append((p, r))
    for group in groups.values():
        ranked = sorted(p for p, _ in group)
        limit = max((p for i, p in enumerate(ranked, 1) if p <= secret_scan.RATE * i / len(ranked)), default=-1)
        for p, r in group:
            assert r.ordinary == (p > limit or r.p < secret_scan.ALPHA), r


def test_code_lengths_are_optimal_and_limited():
    import heapq

    random = np.random.default_rng(1)
    for n in (2, 3, 17, 300):
        counts = {i: int(c) for i, c in enumerate(random.zipf(1.3, n))}
        heap = list(counts.values())
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            best += x
            heapq.heappush(heap, x)
        free = token_files.code_lengths(counts, 40)
        assert sum(counts[s] * k for s, k in free.items()) == best and sum(2.0**-k for k in free.values()) == 1
        limited = token_files.code_lengths(counts, 9)
        assert max(limited.values()) <= 9 and sum(2.0**-k for k in limited.values()) <= 1
    assert token_files.code_lengths({5: 3}) == {5: 1} and token_files.code_lengths({}) == {}


def test_packed_ids_come_back():
    random = np.random.default_rng(2)
    ids = random.zipf(1.2, 20_000) % 5000
    counts = collections.Counter(ids.tolist())
    codes, lens, width = token_files.canonical(token_files.code_lengths(counts))
    first = np.array([0, 1, 1, 700, 20_000])
    raw, starts, inside = token_files.pack(ids, first, codes, lens)
    marks = np.concatenate([starts[i] * 8 + inside[a : b : token_files.STRIDE] for i, (a, b) in enumerate(zip(first[:-1], first[1:]))])
    sizes = np.concatenate([[min(token_files.STRIDE, b - x) for x in range(a, b, token_files.STRIDE)] for a, b in zip(first[:-1], first[1:])]).astype(np.int64)
    out = token_files.unpack(raw, marks, sizes, token_files.decode_table(codes, lens, width), width)
    assert (out == ids).all()


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path


def test_token_files(spark, weird, empty, corpus, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for name, df in (("weird", weird), ("corpus", corpus[0])):
        rows = sorted([(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect()])
        files = token_files.write_tokens(df, vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/{name}")
        got = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r.start)
        assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in rows]
        want = collections.Counter((i, np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows)
        assert collections.Counter((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in got) == want
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    files = token_files.write_tokens(empty, vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/empty")
    assert token_files.read_tokens(spark, files).count() == 0


def test_sentence_pieces(spark, weird, empty, corpus, vocabulary):
    model = vocabulary("piece_bpe_32k.model")
    library = pieces.encoder(model).library
    for df in (weird, corpus[0]):
        texts = collections.Counter((r.doc_id, r.text or "") for r in df.collect())
        want = collections.Counter()
        for (i, t), n in texts.items():
            ids = [1, *library.encode(t), 2]
            want[i, tuple(ids), library.decode(ids), len(t.encode())] += n
        rows = pieces.encode(df, model).collect()
        assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded, max(r.ends)) for r in rows) == want
        for r in rows:
            assert r.begins[0] == 0 and list(r.begins[1:]) == list(r.ends[:-1]) and all(a <= b for a, b in zip(r.begins, r.ends))
        digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(df, model).collect()}
        assert digests == {(i, len(k), hashlib.sha256(np.array(k, "<u4").tobytes()).hexdigest(), sha(d)) for i, k, d, _ in want}
    assert pieces.encode(empty, model).count() == 0


def test_character_map_equals_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = pieces.CharacterMap(model.normalizer_spec.precompiled_charsmap)
    for text in ("ﬁne ①ＡＢＣ ㍿", "각 ｶﾞ", "½™Ⅷ áb", "plain text", "x" * 1000 + "ﬁ"):
        parts = list(own.parts(text))
        assert "".join(a for a, _ in parts) == text
        assert "".join(b for _, b in parts).replace(" ", "▁").lstrip("▁") == library.normalize(text).lstrip("▁")


def test_spans_follow_replacements(vocabulary):
    own = pieces.Encoder(vocabulary("piece_bpe_32k.model"))
    own.map.replacements, own.map.longest, own.map.start = {"ﬁ": "fi", "x́": "x"}, 2, re.compile("[ﬁx]")
    text = "a ﬁne x́y"
    ids, borders, _ = next(own.encode([text]))
    names = [own.library.id_to_piece(int(i)) for i in np.frombuffer(ids, "<u4")]
    raw = text.encode()
    surfaces = {n: raw[a:b].decode() for n, a, b in zip(names, borders[:-1], borders[1:])}
    assert "".join(surfaces.values()) == text and surfaces[next(n for n in names if "f" in n)].strip().startswith("ﬁ")
