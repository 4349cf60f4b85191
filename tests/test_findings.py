import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsdelta.functions import fixed
from opsdelta.operators import findings as FI
from opsdelta.operators import health as HE
from opsdelta.operators import retention as RT
from opsdelta.rules import Registry

S = "id string, rule_id string, category string, severity string, confidence double, resource string, file string, line long, title string, recommendation string, created_at timestamp, evidence_count long"
NOW = dt.datetime(2024, 1, 1)


def f(i, severity="HIGH", confidence=0.7, category="PERFORMANCE", rule="PERF-LOOP-001", resource="r", evidence=1, title="t"):
    return (f"f{i}", rule, category, severity, confidence, resource, "x.lua", i, title, "do", NOW, evidence)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), S)


ALL = list(fixed.CATEGORY_WEIGHTS)


def score(spark, *rows, available=ALL):
    return HE.health_score(table(spark, *rows), available).first()


def test_scores(spark):
    assert score(spark)["score"] == 100 and score(spark, f(1, "INFO"))["score"] == 100
    assert score(spark, f(1, "CRITICAL", 0.49))["score"] > 40 and score(spark, f(1, "CRITICAL", 0.5))["score"] == 40
    assert score(spark, f(1, "HIGH", 0.74))["score"] > 75 and score(spark, f(1, "HIGH", 0.75))["score"] == 75
    half = score(spark, f(1, "MEDIUM", 0.5), available=["PERFORMANCE"])
    assert half["score"] == 95 and half["points"] == 5
    floor = score(spark, *[f(i, "HIGH", 0.7) for i in range(9)], available=["PERFORMANCE"])
    assert floor["score"] == 0
    assert score(spark, f(1, "CRITICAL", 0.9, "SECURITY"), available=["PERFORMANCE"])["score"] == 40
    assert score(spark, f(1), available=[])["score"] == 100


def test_points_add_up_and_errors_count_as_reliability(spark):
    t = table(spark, f(1, "MEDIUM"), f(2, "LOW", 0.5), f(3, "HIGH", 0.4, "ERRORS", "X"))
    cats = {r["health_category"]: r for r in HE.category_scores(t, ALL).collect()}
    assert cats["RELIABILITY"]["points"] == 10 and cats["PERFORMANCE"]["points"] == 9 and cats["SECURITY"]["score"] == 100
    assert sum(r["points"] for r in HE.deductions(t).collect()) == sum(c["points"] for c in cats.values())


def test_reasons(spark):
    t = table(spark, f(0, "HIGH", 0.8), *[f(i, "MEDIUM", 0.5) for i in range(1, 13)], f(20, "LOW", 0.5, rule="PERF-EVENT-001"))
    got = [r["reason"] for r in HE.primary_reasons(t, ALL).orderBy("position").collect()]
    assert got[0].startswith("capped at 75") and got[1] == "MEDIUM: 12 PERF-LOOP-001 findings (-60)" and got[-1].endswith("1 PERF-EVENT-001 finding (-2)")
    assert [r["reason"] for r in HE.primary_reasons(t.limit(0), ALL).collect()] == ["Nothing was deducted: the score is full."]


def test_resources_without_findings_are_scored(spark):
    names = spark.createDataFrame([("r",), ("quiet",)], "resource string")
    got = {r["resource"]: r["score"] for r in HE.health_score(table(spark, f(1, "CRITICAL", 1.0)), ALL, ["resource"], names).collect()}
    assert got == {"r": 40, "quiet": 100}
    assert {r["health_category"] for r in HE.unavailable(spark, ["SECURITY"]).collect()} == set(ALL) - {"SECURITY"}


def test_order_counts_and_filters(spark):
    t = table(spark, f(2, "LOW"), f(1, "LOW"), f(3, "CRITICAL", 0.1), f(4, "LOW", 0.9, "SECURITY"), f(5, "LOW", resource=None))
    assert [r["id"] for r in FI.order_findings(t).collect()] == ["f3", "f4", "f5", "f1", "f2"]
    counts = {r["severity"]: r["finding_count"] for r in FI.count_by_severity(t).collect()}
    assert counts == {"INFO": 0, "LOW": 4, "MEDIUM": 0, "HIGH": 0, "CRITICAL": 1}
    assert FI.filter_findings(t, "MEDIUM").count() == 1 and FI.filter_findings(t, category="security").count() == 1
    assert FI.filter_findings(t, disabled=["PERF-LOOP-001"]).count() == 0
    first = FI.truncated(t, 2).first()
    assert first["total"] == 5 and first["note"].startswith("3 more") and FI.truncated(t, 9).first()["note"] is None
    assert FI.fail_gate(t, "HIGH").first()["failed"] and not FI.fail_gate(t.limit(0), "INFO").first()["failed"]
    assert FI.security_section(t, ran=False) is None


def test_validation(spark):
    t = table(spark, f(1), f(2, evidence=0), f(3, "INFO", evidence=0), f(4, "BAD", 1.5, title=" "), f(5, "LOW", float("nan")))
    got = sorted((r["id"], r["path"]) for r in FI.validate_findings(t).collect())
    assert got == [("f2", "evidence"), ("f4", "confidence"), ("f4", "severity"), ("f4", "title"), ("f5", "confidence")]
    assert [r["accepted"] for r in FI.catalog_join(table(spark, f(1), f(2, rule="NOPE"))).orderBy("id").collect()] == [True, False]


def test_retention(spark):
    day = lambda n: NOW - dt.timedelta(days=n)
    t = spark.createDataFrame([(1, day(31)), (2, day(30)), (3, day(0)), (4, None)], "id int, at timestamp")
    now = F.lit(NOW)
    assert sorted(r["id"] for r in RT.purge(t, "at", now, 30).collect()) == [2, 3, 4]
    assert RT.purge(t, "at", now, 0).count() == 4
    r = {x["table_name"]: (x["deleted"], x["kept"]) for x in RT.purge_counts({"a": (t, "at", 30), "b": (t, "at", 0), "c": (t.limit(0), "at", 30)}, now).collect()}
    assert r == {"a": (1, 3), "b": (0, 4), "c": (0, 0)}


def test_rule_registry(spark, rows):
    reg = Registry()
    reg.register("PERF-LOOP-001", "PERFORMANCE", lambda t: t.select("id"))
    for bad in (("PERF-LOOP-001", "PERFORMANCE"), ("NOPE", "SECURITY"), ("PERF-EVENT-001", "SECURITY")):
        with pytest.raises(ValueError):
            reg.register(*bad, lambda t: t)
    reg.register("PERF-EVENT-001", "PERFORMANCE", lambda t: t.select("id"))
    got = reg.run(table(spark, f(1)), disabled=["PERF-EVENT-001"])
    assert rows(got) == [("f1", "PERF-LOOP-001", "PERFORMANCE")]
    assert reg.activations(["PERF-LOOP-001"]) == [("PERF-EVENT-001", True), ("PERF-LOOP-001", False)]
