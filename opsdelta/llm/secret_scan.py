"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Base spans come from three patterns. Java's regular expressions give matches and
the gaps between them but no positions, so spans are running sums over a row per
gap. All of it is DataFrame work.

The battery looks at every other run of 16 and more token characters that holds a
letter and a digit, or capitals alone (base32 by chance without a digit). A run is cut
at an inner `=`, and where its characters fit no one alphabet, once at `+` and `/` and
once at `_` and `-`; each part is a token of its own. The encoding is inferred from the characters (hex, base32,
base36 or base64, which fixes the alphabet), and under the hypothesis "drawn
uniformly from that alphabet" three tests give p-values: chi-squared over the
symbols, Wald-Wolfowitz runs about the alphabet's middle, and lag-one serial
correlation. The least of the three, times three, is the token's p-value; a token with
one below ALPHA is not random.

Not to be told from random is not yet to be random: tests of short tokens are weak. So
a second null hypothesis, "ordinary text", has to be rejected as well. It is a fixed
model of names, paths and numbers: classes of characters that change seldom, letters as
often as in prose, repeats and ascending steps more often than by chance. The
likelihood under that model over the likelihood under the uniform one exceeds its
inverse with no larger probability than itself (Markov's inequality), so that, times the
number of alphabets to choose from, it is a p-value; it shrinks with the length. False
reports are controlled (Benjamini-Hochberg) within each encoding and length band, over
all tokens of the table, on a fixed grid of p-values; every place of a token counts.
Tokens for which both hold, that carry at least `bits` bits, touch no base span and are
not inside another such token are reported with kind `random`.

Nulls count as empty; empty texts have no spans. Repeated rows each get their own
result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, narrow, staged

# Kinds in their order, with the pattern and the group and length that a match needs.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The next is [0-9a-f]+ with 24 and more characters: runs that fail can be left out at once.
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
]
_TOKEN = "[A-Za-z0-9+/_=-]"
TOKENS = rf"(?<!{_TOKEN})(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])|(?={_TOKEN}*?[A-Z]{{16}})){_TOKEN}{{16,}}+"
#: Parts of a run between inner `=`, and of a part that mixes the separators of two alphabets; padding stays.
PARTS = "[A-Za-z0-9+/_-]+(?:=+$)?"
MIXED = ["[A-Za-z0-9_-]+(?:=+$)?", "[A-Za-z0-9+/]+(?:=+$)?"]

#: The tolerated share of ordinary text among the tokens reported.
RATE = 0.05
#: Uniform tokens that the battery may lose.
ALPHA = 0.001
#: The least information of a reported token.
BITS = 64
#: The grid of p-values: powers of ten by eighths.
STEPS, DEEPEST = 8, 160

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
]

# The model of ordinary text: symbols of four classes (lower case, capitals, digits,
# separators), the chance of each class at the start and after each class, letters in
# thousandths of prose, and the weight of a repeated or ascending symbol inside a class.
_SYMBOLS = [_LOWER, _UPPER, _DIGITS, "+/_-"]
_FIRST = [0.55, 0.25, 0.15, 0.05]
_NEXT = [[0.85, 0.05, 0.04, 0.06], [0.20, 0.70, 0.05, 0.05], [0.10, 0.08, 0.70, 0.12], [0.60, 0.18, 0.20, 0.02]]
_LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
_STEP = 0.2


def _gaps(kind: str, pattern: str, group: int, least: int) -> Column:
    """An element per match of the gap before it and its length, and one for the rest of the text."""
    text = F.col("text")
    parts = {"gap": F.split(text, pattern, -1), "hit": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}
    parts["part"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else parts["hit"]
    element = lambda x, i: F.struct(
        F.lit(kind).alias("kind"),
        i.cast("long").alias("nth"),
        F.length(x["gap"]).cast("long").alias("gap"),
        F.length(x["hit"]).cast("long").alias("width"),
        (F.length(x["part"]) >= least).alias("good"),
        (x["hit"] if kind == "token" else F.lit(None).cast("string")).alias("token"),
    )
    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(*[c.alias(n) for n, c in parts.items()]), element))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_key, doc_id, kind, start, end, token): base spans and candidate tokens, in code points.

    A text without any has one row whose kind is null.
    """
    kinds = [_gaps(*k) for k in BASE] + [_gaps("token", TOKENS, 0, 16)]
    rows = (
        narrow(df, doc_id=id_col, text=text_col)
        .select(F.monotonically_increasing_id().alias("doc_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_key", "doc_id", F.explode_outer(F.flatten(F.array_compact(F.array(*kinds)))).alias("x"))
        .select("doc_key", "doc_id", "x.*")
    )
    along = Window.partitionBy("doc_key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("width", F.lit(0))).over(along)
    return (
        rows.withColumn("end", end)
        .select("doc_key", "doc_id", F.when(F.col("good"), F.col("kind")).alias("kind"), (F.col("end") - F.col("width")).alias("start"), "end", "token", F.col("kind").isNull() | (F.col("nth") == 0) | F.col("good"))
        .toDF("doc_key", "doc_id", "kind", "start", "end", "token", "stays")
        .where("stays")
        .drop("stays")
    )


def _cut(tokens: DataFrame, patterns: list[str]) -> DataFrame:
    """The matches of each pattern in each token, as tokens with their own start and end."""
    element = lambda way: lambda x, i: F.struct(F.lit(way).alias("way"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("width"), x["hit"].alias("part"))
    zipped = lambda p: F.arrays_zip(F.split("token", p, -1).alias("gap"), F.regexp_extract_all("token", F.lit(p), F.lit(0)).alias("hit"))
    parts = F.concat(*[F.transform(zipped(p), element(way)) for way, p in enumerate(patterns)])
    along = Window.partitionBy("doc_key", "start", "way").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tokens.select("doc_key", "doc_id", "kind", "start", F.explode(parts).alias("x")).select("doc_key", "doc_id", "kind", "start", "x.*")
    rows = rows.withColumn("end", F.col("start") + F.sum(F.col("gap") + F.coalesce("width", F.lit(0))).over(along)).where("width is not null")
    return rows.select("doc_key", "doc_id", "kind", (F.col("end") - F.col("width")).alias("start"), "end", F.col("part").alias("token"))


def candidates(runs: DataFrame) -> DataFrame:
    """Runs of token characters cut into tokens that fit an alphabet."""
    inner, mixed = F.col("token").rlike("=[^=]"), F.col("token").rlike("[+/]") & F.col("token").rlike("[_-]")
    runs = runs.select("doc_key", "doc_id", "kind", "start", "end", "token")
    runs = runs.where(~inner).unionByName(_cut(runs.where(inner), [PARTS])).where(F.length("token") >= 16)
    tokens = runs.where(~mixed).unionByName(_cut(runs.where(mixed), MIXED)).where(F.length("token") >= 16)
    return tokens.where((F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")) | F.col("token").rlike("^[A-Z]+=*$"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to rows with a `token`: encoding, n, alphabet_size, p_chi, p_runs, p_serial, p."""
    core = F.regexp_replace("token", "=+$", "")
    chain = lambda which: F.coalesce(*[F.when(F.col("core").rlike(p), F.lit(v[which])) for _, p, *v in ((e[0], e[1], e[0], e[2]) for e in ENCODINGS)])
    df = tokens.withColumn("core", core).withColumn("encoding", chain(0)).withColumn("alphabet", chain(1))
    df = df.withColumn("v", F.transform(F.split("core", "", -1), lambda c: F.instr(F.col("alphabet"), c) - 1))
    df = df.withColumn("v", F.filter("v", lambda x: x >= 0)).withColumn("n", F.size("v")).withColumn("alphabet_size", F.length("alphabet"))
    # Conditions may be evaluated on rows that another one drops: no divisor may be 0.
    n, a = F.nullif(F.col("n").cast("double"), F.lit(0.0)), F.col("alphabet_size").cast("double")
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda s, x: s + f(x))
    after = F.slice("v", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)))
    before = F.slice("v", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))
    df = (
        df.withColumn("squares", total(F.array_distinct("v"), lambda x: F.pow(F.size(F.filter("v", lambda y: y == x)).cast("double"), F.lit(2.0))))
        .withColumn("steps", F.zip_with(before, after, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
        .withColumn("high", total(F.col("v"), lambda x: F.when(x * 2 >= F.col("alphabet_size"), 1.0).otherwise(0.0)))
        .withColumn("runs", 1 + total(F.col("steps"), lambda s: F.when((s["x"] * 2 >= F.col("alphabet_size")) != (s["y"] * 2 >= F.col("alphabet_size")), 1.0).otherwise(0.0)))
        .withColumn("mean", total(F.col("v"), lambda x: x.cast("double")) / n)
        .withColumn("spread", total(F.col("v"), lambda x: F.pow(x - F.col("mean"), F.lit(2.0))))
        .withColumn("serial", total(F.col("steps"), lambda s: (s["x"] - F.col("mean")) * (s["y"] - F.col("mean"))))
    )
    freedom = a - 1
    cube = F.cbrt((a / n * F.col("squares") - n) / freedom)
    z_chi = (cube - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    expected = 2 * F.col("high") * (n - F.col("high")) / n + 1
    deviation = F.sqrt((expected - 1) * (expected - 2) / F.nullif(n - 1, F.lit(0.0)))
    z_runs = F.when(deviation > 0, F.abs(F.col("runs") - expected) / deviation)
    z_serial = F.when(F.col("spread") > 0, F.abs(F.col("serial") / F.col("spread") + 1 / n) * F.sqrt(n))
    df = df.withColumn("p_chi", _normal_tail(z_chi))
    df = df.withColumn("p_runs", F.coalesce(2 * _normal_tail(z_runs), F.lit(0.0))).withColumn("p_serial", F.coalesce(2 * _normal_tail(z_serial), F.lit(0.0)))
    return df.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))).select(
        *tokens.columns, "encoding", "n", "alphabet_size", "p_chi", "p_runs", "p_serial", "p"
    )


def likeness(tested: DataFrame) -> DataFrame:
    """Adds to rows of `battery` `p_text`: the p-value of "ordinary text" against "uniform over the alphabet"."""
    table = lambda values: F.array(*[F.lit(float(v)) for v in values])
    letters = [x / sum(_LETTERS) for x in _LETTERS]
    share = table(letters + letters + [0.1] * 10 + [0.25] * 4)
    kinds = F.array(*[F.lit(k) for k, symbols in enumerate(_SYMBOLS) for _ in symbols])
    first, following = table(_FIRST), table([x for row in _NEXT for x in row])
    number = lambda c: F.instr(F.lit("".join(_SYMBOLS)), c)
    symbol = lambda c: F.struct(number(c).alias("u"), F.get(kinds, number(c) - 1).alias("k"), F.get(share, number(c) - 1).alias("q"))
    df = tested.withColumn("_s", F.transform(F.filter(F.split(F.regexp_replace("token", "=+$", ""), "", -1), lambda c: c != ""), symbol))
    n = F.size("_s")
    same = lambda x, y: (1 - _STEP) * y["q"] + F.when((y["u"] == x["u"]) | (y["u"] == x["u"] + 1), _STEP / 2).otherwise(0.0)
    chance = lambda x, y: F.get(following, x["k"] * 4 + y["k"]) * F.when(x["k"] == y["k"], same(x, y)).otherwise(y["q"])
    steps = F.zip_with(F.slice("_s", F.lit(1), n - 1), F.slice("_s", F.lit(2), n - 1), lambda x, y: F.log2(chance(x, y)))
    start = F.log2(F.get(first, F.get("_s", F.lit(0))["k"]) * F.get("_s", F.lit(0))["q"])
    ratio = F.aggregate(steps, start, lambda s, x: s + x) + n * F.log2("alphabet_size")
    alphabets = len(ENCODINGS)
    return df.withColumn("p_text", F.least(F.lit(1.0), alphabets * F.pow(F.lit(2.0), F.least(F.lit(0.0), ratio)))).drop("_s")


def ordinary(tested: DataFrame, rate: float = RATE, alpha: float = ALPHA) -> DataFrame:
    """Adds `ordinary` to rows of `battery`: false only if uniform stands and ordinary text is rejected.

    `rate` bounds the share of ordinary text among the rejected, within each encoding and length band.
    """
    tested = staged(likeness(tested), "tested-tokens")  # read twice below, and conditions on p-values stay out of the battery's plan
    step = F.least(F.lit(DEEPEST), F.floor(-F.log10(F.greatest("p_text", F.lit(1e-300))) * STEPS)).cast("int")
    df = tested.withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("step", step)
    stratum = Window.partitionBy("encoding", "band")
    deeper = stratum.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limits = (  # a few bands times at most DEEPEST + 1 steps
        df.groupBy("encoding", "band", "step").count()
        .withColumn("below", F.sum("count").over(deeper)).withColumn("all", F.sum("count").over(stratum))
        .where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("below") / F.col("all"))
        .groupBy("encoding", "band").agg(F.min("step").alias("limit"))
    )
    rejected = F.coalesce(F.col("step") >= F.col("limit"), F.lit(False))
    return df.join(F.broadcast(limits), ["encoding", "band"], "left").withColumn("ordinary", ~rejected | (F.col("p") < alpha)).drop("band", "step", "limit")


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, bits: float = BITS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_spans, all_spans.

    Spans are structs (start, rank of the kind, kind, end) in code points, end exclusive, sorted.
    """
    found = staged(spans(df, id_col, text_col), "secret-spans")
    rank = {k[0]: i for i, k in enumerate(BASE)} | {"random": len(BASE)}
    span = lambda kind: F.struct("start", F.create_map(*[F.lit(v) for kv in rank.items() for v in kv])[kind].alias("rank"), kind.alias("kind"), "end")
    is_base = F.col("kind").isin([k[0] for k in BASE])
    tested = ordinary(battery(candidates(found.where("kind = 'token'"))), rate)
    random = tested.where(~F.col("ordinary") & (F.col("n") * F.log2("alphabet_size") >= bits)).select("doc_key", "doc_id", F.lit("random").alias("kind"), "start", "end")
    rows = found.select("doc_key", "doc_id", F.when(is_base, F.col("kind")).alias("kind"), "start", "end").unionByName(random)
    docs = rows.groupBy("doc_key", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(is_base, span(F.col("kind"))))).alias("base_spans"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "random", span(F.col("kind"))))).alias("tokens"),
        *[F.count(F.when(F.col("kind") == k[0], 1)).alias(f"n_{k[0]}") for k in BASE],
    )
    free = F.filter("tokens", lambda t: ~F.exists("base_spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    outer = F.filter("random", lambda t: ~F.exists("random", lambda o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])))
    return docs.withColumn("random", free).withColumn("random", outer).select(
        "doc_id", *[f"n_{k[0]}" for k in BASE], F.size("random").cast("long").alias("n_random"), "base_spans", F.array_sort(F.concat("base_spans", "random")).alias("all_spans")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return secret_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), "n_random"
    )
