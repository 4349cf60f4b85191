import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsdelta.operators.joins import disjoint_join, interval_join, near_join, span_blocks
from opsdelta.operators.ordered import last_within, ranked, sessionize, with_previous

T0 = dt.datetime(2024, 1, 1)


def times(n=600, seed=1):
    """A hot key with most rows, bursts, gaps of days, and equal times."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.8 else rnd.choice("abc")
        at = T0 + dt.timedelta(milliseconds=rnd.choice([rnd.randrange(10**9), rnd.randrange(50) * 3_600_000, 86_400_000 * rnd.randrange(9)]))
        out.append((i, key, at, rnd.choice(["on", "off"])))
    return out


def test_previous_equals_a_plain_lag(spark, rows):
    df = spark.createDataFrame(times(), "id long, k string, t timestamp, s string")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows(df.withColumn("prev_s", F.lag("s").over(w)).withColumn("prev_id", F.lag("id").over(w)).select("id", "prev_s", "prev_id"))
    for span in ("1h", "1d", "30d"):
        got = with_previous(df, ["k"], "t", "id", ["s", "id"], span).select("id", "prev_s", "prev_id")
        assert rows(got) == want


def test_sessions_equal_the_plain_form(spark, rows):
    df = spark.createDataFrame(times(seed=2), "id long, k string, t timestamp, s string")
    gap = 3_600_000
    w = Window.partitionBy("k").orderBy("t", "id")
    start = F.when(F.lag("t").over(w).isNull() | (F.unix_millis("t") - F.unix_millis(F.lag("t").over(w)) > gap), F.col("t"))
    plain = df.withColumn("st", start).withColumn("session_start", F.max("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = rows(plain.select("id", "session_start"))
    for span in ("2h", "1d"):
        assert rows(sessionize(df, ["k"], "t", gap, span).select("id", "session_start")) == want


def test_a_gap_of_exactly_the_window_stays_together(spark):
    at = [T0, T0 + dt.timedelta(milliseconds=1000), T0 + dt.timedelta(milliseconds=2001)]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(at)], "id long, k string, t timestamp")
    got = [r["session_start"] for r in sessionize(df, ["k"], "t", 1000).orderBy("id").collect()]
    assert got == [T0, T0, at[2]]


def test_rank_equals_row_number(spark, rows):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["hot", "hot", "hot", "x", None]), rnd.randrange(3), rnd.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, k string, a int, b int")
    w = Window.partitionBy("k").orderBy(F.col("a").desc(), F.col("b").asc(), F.col("id").asc())
    want = rows(df.withColumn("position", F.row_number().over(w).cast("bigint")))
    assert rows(ranked(df, ["k"], [(F.col("a"), True), (F.col("b"), False)], [F.col("id").asc()])) == want


def test_range_joins_equal_the_nested_loop(spark, rows):
    rnd = random.Random(4)
    a = [("k" if rnd.random() < 0.7 else "q", rnd.randrange(-300, 300), i) for i in range(150)]
    b = [("k" if rnd.random() < 0.7 else "q", rnd.randrange(-300, 300), i) for i in range(150)]
    left, right = spark.createDataFrame(a, "k string, x long, i long"), spark.createDataFrame(b, "k string, y long, j long")
    for low, high in ((-20, 20), (0, 60), (5, 5)):
        want = sorted((p[2], q[2]) for p in a for q in b if p[0] == q[0] and low <= q[1] - p[1] <= high)
        got = near_join(left, right, ["k"], F.col("x"), F.col("y"), low, high).select("i", "j")
        assert sorted(tuple(r) for r in got.collect()) == want
    spans = spark.createDataFrame([(k, y, y + rnd.randrange(0, 90), j) for k, y, j in b], "k string, lo long, hi long, j long")
    want = sorted((p[2], s["j"]) for p in a for s in spans.collect() if p[0] == s["k"] and s["lo"] <= p[1] < s["hi"])
    got = interval_join(left, spans, ["k"], F.col("x"), F.col("lo"), F.col("hi"), 16).select("i", "j")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_interval_join_of_short_and_long_spans(spark):
    rnd = random.Random(11)
    points = [(i, "ab"[i % 2], rnd.randrange(-5000, 2_000_000) if i % 3 else rnd.randrange(-200, 300)) for i in range(400)] + [(400, "a", None)]
    spans = [(0, "a", -5000, 1_000_000), (1, "b", 0, 1), (2, "a", 5, 5), (3, "a", -64, 64), (4, "b", -1, 65), (5, "b", 255, 257)]
    for j in range(6, 60):
        lo = rnd.randrange(-300, 300)
        spans.append((j, "ab"[j % 2], lo, lo + rnd.choice([1, 2, 63, 64, 65, 256, 300, 4096, 70_000, 1_500_000])))
    p = spark.createDataFrame(points, "i long, k string, x long")
    s = spark.createDataFrame(spans, "j long, k string, lo long, hi long")
    got = interval_join(p, s, ["k"], F.col("x"), F.col("lo"), F.col("hi"), 64).select("i", "j")
    want = [(i, j) for i, k, x in points for j, kk, lo, hi in spans if k == kk and x is not None and lo <= x < hi]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    blocks = s.where("hi > lo").select(F.size(span_blocks(F.col("lo"), F.col("hi"), 64)).alias("n"))
    assert blocks.agg(F.max("n")).first()[0] == 2
    assert interval_join(p, s.limit(0), ["k"], F.col("x"), F.col("lo"), F.col("hi"), 64).count() == 0


def test_disjoint_join_keeps_points_outside(spark, rows):
    p = spark.createDataFrame([(1, "a", 3), (2, "a", 900), (3, "b", 3), (4, "a", None)], "i long, k string, x long")
    s = spark.createDataFrame([("u", "a", 0, 10), ("v", "a", 10, 300)], "j string, k string, lo long, hi long")
    got = disjoint_join(p, s, ["k"], F.col("x"), F.col("lo"), F.col("hi"), 16, "left").select("i", "j")
    assert rows(got) == [(1, "u"), (2, None), (3, None), (4, None)]


def test_last_within_equals_a_search(spark):
    rnd = random.Random(21)
    facts = {("hot" if rnd.random() < 0.8 else "q", rnd.randrange(-4000, 4000)): i for i in range(300)}
    asks = {("hot" if rnd.random() < 0.8 else "z", rnd.randrange(-4200, 4200)) for _ in range(500)} | set(list(facts)[:40])
    f = spark.createDataFrame([(k, at, f"v{v}") for (k, at), v in facts.items()], "k string, at long, v string")
    a = spark.createDataFrame(sorted(asks), "k string, at long")
    for reach, parts in ((1000, 64), (37, 4), (1, 64)):
        want = []
        for k, at in asks:
            near = [t for kk, t in facts if kk == k and at - reach <= t <= at]
            if near:
                want.append((k, at, f"v{facts[k, max(near)]}"))
        got = last_within(f, a, ["k"], "at", "v", reach, parts)
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert last_within(f.limit(0), a, ["k"], "at", "v", 10).count() == 0
