import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsdelta.operators import regression as RG
from opsdelta.operators import stats as ST

S = "resource string, metric string, value double, unit string, player_count long, side string"


def stable(name, side, mean, n=30, players=None):
    return [(name, "m", mean * (1.02 if i % 2 else 0.98), "ms", players, side) for i in range(n)]


def test_bad_values_are_dropped_and_an_empty_group_is_zero(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("b", float("-inf")), ("b", None)], "k string, v double"
    )
    got = {r["k"]: r for r in ST.summarize(df, ["k"], "v").collect()}
    assert (got["a"]["sample_count"], got["a"]["mean"], got["a"]["median"], got["a"]["standard_deviation"]) == (2, 2.0, 2.0, 1.0)
    assert tuple(got["b"])[1:] == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.fixture
def many_parts(spark):
    """Small parts stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("shape", ["uniform", "outlier", "two scales", "ties", "single"])
def test_percentiles_of_hot_groups_equal_plain_python(spark, shape, many_parts):
    rnd = random.Random(5)
    make = {
        "uniform": lambda: rnd.random() * 100, "outlier": lambda: rnd.choice([rnd.random(), 1e12]),
        "two scales": lambda: rnd.random() * rnd.choice([1e-9, 1.0, 1e15]), "ties": lambda: float(rnd.randrange(3)), "single": lambda: 4.0,
    }[shape]
    data = [(k, make()) for k in ("hot",) * 9000 + ("cold",) * 31 + (None,) * 7] + [("one", 2.5), ("bad", None), ("bad", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    ps = [-3, 0, 37.5, 50, 95, 99.99, 100]
    got = {r["k"]: r for r in ST.percentiles(df, ["k"], "v", ps).collect()}
    assert got.keys() == {"hot", "cold", None, "one"}
    for k in got:
        values = sorted(v for key, v in data if key == k)
        assert got[k]["n"] == len(values)
        assert list(got[k])[2:] == pytest.approx(np.percentile(values, np.clip(ps, 0, 100)).tolist(), rel=1e-9)
    summary = {r["k"]: r for r in ST.summarize(df, ["k"], "v").collect()}
    assert len(summary) == 5 and (summary["bad"]["median"], summary["bad"]["p95"]) == (0.0, 0.0)
    assert summary["cold"]["median"] == got["cold"]["p3"]


def test_percentiles_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert [tuple(r) for r in ST.percentiles(df, [], "v", [50, 75]).collect()] == [(3, 2.0, 3.0)]
    assert ST.percentiles(df.where("false"), [], "v", [50]).collect() == []
    assert ST.summarize(df, [], "v").first()["median"] == 2.0


def test_a_hot_group_is_dealt_out_in_order(spark, many_parts):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.rand(3).alias("v"))
    folded = df.groupBy("k", F.col("v").alias("_v")).count().repartitionByRange("k", "_v").withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in folded.groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 150_000


def test_verdicts(spark):
    noisy = [("noisy", "m", v, "ms", None, "before") for v in [0.1, 9.0] * 10] + stable("noisy", "after", 20.0)
    cases = {
        "double": (1.0, 2.1, "REGRESSION"), "more": (1.0, 1.6, "REGRESSION"), "tiny": (0.01, 0.04, "BELOW_ABSOLUTE_THRESHOLD"),
        "little": (10.0, 12.0, "BELOW_RELATIVE_THRESHOLD"), "better": (2.0, 0.9, "IMPROVEMENT"), "same": (1.0, 1.0, "UNCHANGED"),
        "zero": (0.0, 1.0, "REGRESSION"),
    }
    data = noisy
    for name, (b, a, _) in cases.items():
        data = data + stable(name, "before", b) + stable(name, "after", a)
    data += stable("seven", "before", 1.0, 7) + stable("seven", "after", 9.0, 30)
    data += stable("eight", "before", 1.0, 8) + stable("eight", "after", 9.0, 8)
    data += stable("gone", "before", 1.0)
    df = spark.createDataFrame(data, S)
    got = {r["resource"]: r for r in RG.explain_verdict(RG.judge(RG.compare_windows(df))).collect()}
    for name, (_, _, verdict) in cases.items():
        assert got[name]["verdict"] == verdict, name
    assert got["noisy"]["verdict"] == "BASELINE_TOO_NOISY"
    assert got["seven"]["verdict"] == "INSUFFICIENT_SAMPLES" and got["eight"]["verdict"] == "REGRESSION"
    assert got["gone"]["verdict"] == "INSUFFICIENT_SAMPLES" and got["gone"]["after_count"] == 0
    assert got["zero"]["relative_change"] == float("inf") and "not comparable" in got["zero"]["explanation"]
    for r in got.values():
        assert (r["confidence"] == 0) == (r["verdict"] not in ("REGRESSION", "IMPROVEMENT")) and r["confidence"] <= 0.9
    found = {r["resource"]: r for r in RG.regression_findings(RG.judge(RG.compare_windows(df)), "a", "b").collect()}
    assert found["double"]["severity"] == "HIGH" and found["more"]["severity"] == "MEDIUM" and len(found["double"]["evidence"]) == 3


def test_player_load_only_counts_with_a_limit(spark):
    df = spark.createDataFrame(stable("r", "before", 1.0, players=60) + stable("r", "after", 3.0, players=3), S)
    plain = RG.judge(RG.compare_windows(df)).first()
    limited = RG.judge(RG.compare_windows(df), RG.Thresholds(max_player_delta=10)).first()
    assert plain["verdict"] == "REGRESSION" and limited["verdict"] == "CONTEXT_MISMATCH"


def test_input_order_does_not_matter(spark, rows):
    df = spark.createDataFrame(stable("r", "before", 1.0) + stable("r", "after", 3.0), S)
    cols = ["resource", "verdict", "confidence"]
    a = rows(RG.judge(RG.compare_windows(df)).select(*cols))
    assert a == rows(RG.judge(RG.compare_windows(df.repartition(5).orderBy(F.rand(3)))).select(*cols))


def test_nothing_to_compare_is_said(spark):
    none = spark.createDataFrame([], S)
    half = spark.createDataFrame(stable("r", "before", 1.0), S)
    a, b = RG.compared_guard(none).first(), RG.compared_guard(half).first()
    assert not a["compared"] and not b["compared"] and a["reason"] != b["reason"]
    assert RG.compared_guard(half.unionByName(spark.createDataFrame(stable("r", "after", 1.0), S))).first()["reason"] is None


def test_explained_means_do_not_hang_on_the_order_of_sums(spark):
    q = [26, 8, 17, 8, 8, 6, 40, 22, 42, 26, 14, 45, 7, 2, 40, 43]
    # added up as doubles in this order the mean rounds to 6.637; it is 6.6375
    rows = [("a", "m", 0.3 * x, "ms", None, "before") for x in q] + [("a", "m", 90.0, "ms", None, "after")] * 8
    judged = RG.judge(RG.compare_windows(spark.createDataFrame(rows, S).coalesce(1), mean=ST.exact_mean))
    assert "6.638 to 90.000 ms" in RG.explain_verdict(judged).first()["explanation"]
    odd = spark.createDataFrame([(1e300,), (0.5,), (None,)], "v double")
    assert odd.agg(ST.exact_sum(F.col("v")).alias("s"), ST.exact_mean(F.col("v")).alias("m")).first() == (1e300, 5e299)
