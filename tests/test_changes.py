import datetime as dt
import random

from pyspark.sql import functions as F

from opsdelta.functions import fixed
from opsdelta.operators import baselines as BL
from opsdelta.operators import incidents as CO
from opsdelta.operators import integrity as IN
from opsdelta.operators.tables import replace_by_key, upsert

T0 = dt.datetime(2024, 1, 1, 12)
HALF = 30 * 60 * 1000
SIG = "id long, server_id string, kind string, occurred_at timestamp, resource string, description string, finding_id string"


def sig(i, kind, ms, resource="a", server="s", finding=None):
    at = None if ms is None else T0 + dt.timedelta(milliseconds=ms)
    return (i, server, kind, at, resource, f"{kind} {resource}", finding)


def signals(spark, *data):
    return spark.createDataFrame(list(data), SIG)


# ---------------------------------------------------------------- baselines


def test_samples_go_to_the_next_baseline_after_they_are_known(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    samples = spark.createDataFrame(
        [
            (1, "s", day(1), None), (2, "s", day(5), day(5)), (3, "s", day(5, 1), day(5, 1)), (4, "s", day(2), day(8)),
            (5, "s", day(20), day(20)), (6, "other", day(1), day(1)),
        ],
        "id int, server_id string, sampled_at timestamp, imported_at timestamp",
    )
    bl = spark.createDataFrame([("s", "b1", day(5)), ("s", "b2", day(10))], "server_id string, label string, created_at timestamp")
    got = {r["id"]: r["baseline_label"] for r in BL.claim_samples(samples, bl).collect()}
    assert got == {1: "b1", 2: "b1", 3: "b2", 4: "b2", 5: None, 6: None}


def test_resource_differences(spark):
    s = "resource string, content_hash string, file_count long, total_bytes long, version string"
    b = spark.createDataFrame([("same", "h", 1, 1, None), ("gone", "h", 1, 1, "1"), ("edit", "h", 1, 5, None)], s)
    a = spark.createDataFrame([("same", "h", 1, 1, None), ("new", "h", 1, 1, "1"), ("edit", "i", 2, 5, "2")], s)
    got = {r["resource"]: (r["kind"], len(r["details"])) for r in BL.diff_resources(b, a).collect()}
    assert got == {"same": ("UNCHANGED", 0), "gone": ("REMOVED", 1), "new": ("ADDED", 1), "edit": ("MODIFIED", 3)}


def test_unknown_sides_change_nothing(spark):
    s = "server_id string, config_fingerprint string, health_score long"
    b = spark.createDataFrame([("x", None, 80), ("y", "f", None), ("z", "f", 80)], s)
    a = spark.createDataFrame([("x", "g", 70), ("y", "f", 70), ("z", "g", 70)], s)
    got = {r[0]: tuple(r)[1:] for r in BL.compare_headers(b, a).collect()}
    assert got == {"x": (False, -10), "y": (False, None), "z": (True, -10)}


def test_upsert_and_replace(spark, rows):
    s = "k string, first_seen long, v long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], s)
    new = spark.createDataFrame([("b", 9, 2), ("c", 9, 2)], s)
    assert rows(upsert(old, new, ["k"], keep_first=["first_seen"])) == [("a", 1, 1), ("b", 1, 2), ("c", 9, 2)]
    assert rows(upsert(old, new, ["k"], update=["first_seen"])) == [("a", 1, 1), ("b", 9, 1), ("c", 9, 2)]
    assert rows(replace_by_key(old.unionByName(old), new, ["k"])) == [("a", 1, 1), ("a", 1, 1), ("b", 9, 2), ("c", 9, 2)]
    assert rows(upsert(old, new.limit(0), ["k"])) == rows(old)


# ---------------------------------------------------------------- integrity

ENTRY = "path string, resource string, size_bytes long, hash string, modified_at timestamp"


def test_snapshot_differences(spark):
    e = lambda p, h="h", t=T0, r="r", n=1: (p, r, n, h, t)
    later = T0 + dt.timedelta(1)
    before = spark.createDataFrame([e("same"), e("gone"), e("edit"), e("touch"), e("root", r=None)], ENTRY)
    after = spark.createDataFrame([e("same"), e("new"), e("edit", "i", n=2), e("touch", t=later), e("root", "j", r=None)], ENTRY)
    got = {r["path"]: r for r in IN.diff_snapshots(before, after).collect()}
    assert {p: r["kind"] for p, r in got.items()} == {"gone": "DELETED", "new": "ADDED", "edit": "MODIFIED", "touch": "TOUCHED", "root": "MODIFIED"}
    assert len(got["edit"]["details"]) == 2 and len(got["root"]["details"]) == 1
    found = {r["resource"]: r for r in IN.changes_by_resource(IN.diff_snapshots(before, after), "a", "b").collect()}
    assert (found["r"]["added"], found["r"]["modified"], found["r"]["deleted"]) == (1, 1, 1) and found[None]["modified"] == 1
    s = IN.diff_summary(before, after).first()
    assert (s["unchanged_count"], s["touched_count"], s["identical"]) == (1, 1, False)
    head = lambda df: IN.snapshot_header(df, "s", "l").first()["snapshot_hash"]
    moved = before.withColumn("modified_at", F.lit(later))
    assert head(before) == head(moved) != head(after) and IN.diff_summary(before, moved).first()["identical"]


def test_evidence_is_bounded_and_ordered(spark):
    after = spark.createDataFrame([(f"p{i:02d}", "r", 1, "h", T0) for i in range(30)], ENTRY)
    before = spark.createDataFrame([("old", "r", 1, "h", T0)], ENTRY)
    got = sorted((r["position"], r["kind"], r["path"]) for r in IN.change_evidence(IN.diff_snapshots(before, after)).collect())
    assert len(got) == 25 and got[0] == (1, "ADDED", "p00") and got[24] == (25, "ADDED", "p24")
    assert IN.change_evidence(IN.diff_snapshots(before, before)).collect() == []


# -------------------------------------------------------------- correlation


def test_window_edges(spark):
    df = signals(
        spark, sig(1, "RESOURCE_CHANGED", 0), sig(2, "ERROR_SPIKE", HALF), sig(3, "ERROR_SPIKE", HALF + 1), sig(4, "HITCH", -HALF),
        sig(5, "HITCH", None), sig(6, "HITCH", 0, server="t"), sig(7, "FINDING_RESOLVED", 1), sig(8, "CONFIG_CHANGED", 10, None),
    )
    links = {(r["change_id"], r["effect_id"]): r for r in CO.correlate(df).collect()}
    assert set(links) == {(1, 2), (1, 4), (8, 2), (8, 3)}
    assert links[1, 2]["confidence"] == 0.55 and links[1, 4]["confidence"] == 0.45
    assert links[8, 3]["delta_ms"] == HALF - 9


def test_confidence_values(spark):
    df = signals(
        spark, sig(1, "RESOURCE_CHANGED", 0), sig(2, "ERROR_SPIKE", 300_000), sig(3, "ERROR_SPIKE", 300_000, "b"), sig(4, "CONFIG_CHANGED", 300_000),
    )
    got = {(r["change_id"], r["effect_id"]): (r["confidence"], r["r"]) for r in CO.correlate(df).withColumn("r", CO.link_reasons()).collect()}
    assert got[1, 2][0] == 0.8 and got[1, 3][0] == 0.45 and got[4, 2][0] == 0.85 and got[4, 3][0] == 0.55
    assert len(got[4, 2][1]) == 3 and "same timestamp" in got[4, 2][1]


def test_strongest_links_equal_the_best_of_all_pairs(spark, rows):
    rnd = random.Random(7)
    kinds = fixed.CHANGE_KINDS + fixed.EFFECT_KINDS + ["FINDING_RESOLVED"]
    data = []
    for i in range(500):
        kind = rnd.choice(kinds)
        resource = None if rnd.random() < 0.2 else rnd.choice("abc")
        server = "hot" if rnd.random() < 0.8 else rnd.choice("xy")
        data.append(sig(i, kind, rnd.randrange(0, 40 * HALF, rnd.choice([1, HALF // 2])), resource, server))
    df = signals(spark, *data)
    cols = ["effect_id", "change_id", "delta_ms", "confidence"]
    best = {}
    for r in CO.correlate(df).select(*cols).collect():
        key = (-r["confidence"], r["delta_ms"], r["change_id"])
        if r["effect_id"] not in best or key < best[r["effect_id"]][0]:
            best[r["effect_id"]] = (key, tuple(r))
    assert rows(CO.strongest_links(df).select(*cols)) == sorted((t for _, t in best.values()), key=repr) and best


def test_incidents(spark, rows):
    df = signals(
        spark,
        sig(1, "RESOURCE_CHANGED", 0), sig(2, "PERFORMANCE_REGRESSION", 60_000), sig(3, "RESOURCE_ADDED", 60_000 + HALF, "b"),
        sig(4, "RESOURCE_CHANGED", 10 * HALF), sig(5, "CONFIG_CHANGED", 10 * HALF, None),
        sig(6, "HEALTH_DROP", 20 * HALF, None), sig(7, "RESOURCE_REMOVED", 20 * HALF, "z"),
        sig(8, "HITCH", None),
    )
    got = {r["severity"]: r for r in CO.build_incidents(df).collect()}
    assert set(got) == {"HIGH", "MEDIUM"} and got["HIGH"]["event_count"] == 3
    assert got["MEDIUM"]["ended_at"] is None and got["HIGH"]["ended_at"] is not None
    assert (got["HIGH"]["change_count"], got["HIGH"]["effect_count"]) == (2, 1)
    assert rows(CO.build_incidents(df)) == rows(CO.build_incidents(df.repartition(3)))
    findings = spark.createDataFrame([("f1",)], "id string")
    linked = df.withColumn("finding_id", F.when(F.col("id") == 1, "f1").when(F.col("id") == 2, "gone"))
    t = CO.incident_timeline(linked, CO.build_incidents(linked), findings, HALF)
    assert {r["event_id"]: r["finding_id"] for r in t.collect()} == {1: "f1", 2: None, 3: None, 6: None, 7: None}
    assert CO.build_incidents(df.where("id in (4, 5)")).collect() == [] == CO.build_incidents(df.limit(0)).collect()
    near = {(r["server_id"], r["resource"]) for r in CO.affected_resources(df).collect()}
    assert near == {("s", "a"), ("s", "b"), ("s", "z")}


def test_state_changes(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    df = spark.createDataFrame(
        [(1, "r", at(0), "on"), (2, "r", at(1), "on"), (3, "r", at(40), "on"), (4, "r", at(41), "off"), (5, "q", at(0), "off")],
        "id long, resource string, observed_at timestamp, state string",
    )
    got = {r["id"]: r["kind"] for r in CO.state_changes(df).collect()}
    assert got == {1: "resource_state", 4: "resource_state_changed", 5: "resource_state"}


def test_snapshots_are_found_by_id_or_label_and_deleted(spark):
    from opsdelta.operators import integrity as IN

    rows = spark.createDataFrame([("s1", "day", 1), ("s2", "day", 2), ("s3", "other", 3), ("day", "x", 0)], "id string, label string, created_at int")
    found = lambda name: [r["id"] for r in IN.find_snapshot(rows, name).collect()]
    assert (found("s1"), found("other"), found("day"), found("none")) == (["s1"], ["s3"], ["day"], [])
    files = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s2", "c")], "snapshot_id string, path string")
    assert [r["path"] for r in IN.delete_snapshot(files, IN.find_snapshot(rows, "s2")).collect()] == ["a"]


def test_purge_scopes(spark):
    import datetime

    from pyspark.sql import functions as F

    from opsdelta.operators import retention as RT

    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", day), ("a", None), ("b", day), (None, day)], "server_id string, at timestamp")
    now = F.lit("2024-03-01").cast("timestamp")
    left = lambda *a, **k: sorted(str(r["server_id"]) for r in RT.purge(df, "at", now, 30, *a, **k).collect())
    assert left() == ["a"] and left("a") == ["None", "a", "b"] and left("a", everything=True) == ["None", "b"] and left(everything=True) == []
    assert RT.purge_counts({"t": (df.drop("server_id"), "at", 30)}, now, "a", True).first()["deleted"] == 0


def _plan(df):
    """The optimised plan without the given rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "\n".join(line for line in plan.splitlines() if "LogicalRDD" not in line)


def test_links_carry_ids_and_look_up_descriptions_only_where_asked(spark):
    df = signals(spark, sig(1, "RESOURCE_CHANGED", 0), sig(2, "ERROR_SPIKE", 60_000))
    lean = _plan(CO.strongest_links(df).select("effect_id", "change_id", "confidence"))
    assert "LeftOuter" not in lean and "description" not in lean
    lean = _plan(CO.build_incidents(df).select("id", "severity"))
    assert "LeftOuter" not in lean and "description" not in lean
    full = CO.strongest_links(df).first()
    assert (full["change_description"], full["change_kind"], full["effect_description"]) == ("RESOURCE_CHANGED a", "RESOURCE_CHANGED", "ERROR_SPIKE a")


def test_recent_incidents_group_the_signals_once(spark, rows):
    data = [s for i in range(8) for s in (sig(10 * i, "CONFIG_CHANGED", 4 * i * HALF, None), sig(10 * i + 1, "ERROR_SPIKE", 4 * i * HALF + 5, finding=f"f{i % 4}"))]
    df = signals(spark, *data, sig(5, "HITCH", 28 * HALF + HALF + 5), sig(6, "HITCH", 31 * HALF), sig(7, "HITCH", 28 * HALF, server="t"))
    findings = spark.createDataFrame([("f1",), ("f3",)], "id string")
    got = CO.recent_incidents(df, CO.build_incidents(df), findings, 2)
    assert rows(got.select("event_id", "finding_id")) == rows(spark.createDataFrame([(60, None), (61, None), (70, None), (71, "f3"), (5, None)], "a long, b string"))
    whole = CO.incident_timeline(df, CO.build_incidents(df), findings, HALF)
    newest = got.select("incident_id").distinct()
    assert rows(got.select(whole.columns)) == rows(whole.join(newest, "incident_id").select(whole.columns))
    assert "Window" not in _plan(got)


def test_merged_shuffle_partitions_stay_small_unless_the_session_says_otherwise(spark):
    from opsdelta.plans import QUERIES
    from opsdelta.session import ADVISORY, PART_BYTES

    spark.conf.unset(ADVISORY)
    QUERIES["incidents"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(ADVISORY) == PART_BYTES
    spark.conf.set(ADVISORY, "1m")
    QUERIES["incidents"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(ADVISORY) == "1m"
    spark.conf.unset(ADVISORY)
