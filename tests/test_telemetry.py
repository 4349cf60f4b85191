import json

from pyspark.sql import functions as F

from opsdelta.sources import inventory as INV
from opsdelta.sources import telemetry as TM
from opsdelta.streaming import streams as SS

SAMPLE = {"metric": "m", "value": 3, "unit": "ms", "at": 1.5}


def doc(**extra):
    return {"schemaVersion": "1.0", "collector": "c", "samples": [SAMPLE], "events": [{"kind": "k", "at": 2}], "writtenAt": 10, **extra}


def raw(spark, *docs):
    data = [(f"f{i}", "s", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(data, "file string, server_id string, json string")


def test_bad_documents_are_rows_not_failures(spark):
    p = TM.parse(raw(spark, doc(), "{oops", "[1]", '"x"', {"a": 1}, doc(schemaVersion=1), doc(schemaVersion="2.0")))
    assert [r["reason"] for r in p.orderBy("file").collect()] == [
        None, "not valid JSON", "not a JSON object", "not a JSON object", "no schemaVersion", "no schemaVersion", "unsupported schemaVersion 2.0",
    ]
    assert TM.documents(p).count() == 1 and TM.problems(p).count() == 6


def test_fields_need_their_type(spark):
    bad = [
        {**SAMPLE, "value": "3"}, {**SAMPLE, "value": None}, {**SAMPLE, "value": "NaN"}, {**SAMPLE, "value": True}, {**SAMPLE, "metric": 2}, {**SAMPLE, "at": "1"},
        {"metric": "m"}, 7, [SAMPLE], None, {**SAMPLE, "value": {"value": 1}},
    ]
    good = [{**SAMPLE, "playerCount": "x"}, {**SAMPLE, "playerCount": 4, "value": 1e3, "extra, unit: STRING": [1]}, {**SAMPLE, "value": -2}]
    events = [{"kind": "k", "at": 2, "resource": 5, "detail": "d"}, {"kind": 1, "at": 2}, {"kind": "k"}, "x"]
    d = TM.documents(TM.parse(raw(spark, doc(samples=bad + good, events=events), doc(samples={"a": 1}, events=3))))
    s = TM.explode_samples(d).collect()
    assert [(r["value"], r["player_count"]) for r in s] == [(3.0, None), (1000.0, 4.0), (-2.0, None)]
    assert [(r["resource"], r["detail"]) for r in TM.explode_events(d).collect()] == [(None, "d")]


def test_defaults_and_drops(spark):
    d = TM.documents(TM.parse(raw(spark, {"schemaVersion": "1.0"}, doc(collectorVersion="2", dropped={"samples": 3, "events": 4}, writtenAt=0), doc(dropped={"samples": 3}))))
    a, b, c = d.orderBy("file").collect()
    assert (a["collector"], a["collector_version"], a["written_at"], a["samples"], a["dropped_samples"]) == ("collector", None, 0.0, [], 0)
    assert (b["dropped_samples"], b["dropped_events"], c["dropped_samples"]) == (3, 4, 0)
    assert {r["source"] for r in TM.stored_samples(d).collect()} == {"c@2", "c@unknown"}
    s = TM.summary(d).first()
    assert (s["document_count"], s["sample_count"], s["dropped_events"]) == (3, 2, 4)
    none = TM.summary(d.limit(0)).first()
    assert none["earliest"] is None and none["sample_count"] == 0
    assert not TM.performance_section(TM.parse(raw(spark, "x"))).first()["collected"]


def test_digests_know_content_not_names(spark):
    other = {**SAMPLE, "value": 4}
    d = TM.with_digest(TM.documents(TM.parse(raw(spark, doc(), doc(), doc(writtenAt=11), doc(samples=[SAMPLE, other]), doc(samples=[other, SAMPLE])))))
    g = [r["digest"] for r in d.orderBy("file").collect()]
    assert g[0] == g[1] != g[2] and g[3] == g[4] != g[0]


def test_imports_happen_once(spark):
    d = TM.with_digest(TM.documents(TM.parse(raw(spark, doc(), doc(), doc(writtenAt=0)))))
    empty = spark.createDataFrame([], "server_id string, digest string")
    first = TM.ingest_once(d, empty)
    assert [r["status"] for r in first.orderBy("file").collect()] == ["IMPORTED", "ALREADY_IMPORTED", "IMPORTED"]
    ledger = TM.ledger_rows(first, F.current_timestamp())
    assert sorted(r["written_at"] is None for r in ledger.collect()) == [False, True]
    again = TM.ingest_once(d, ledger)
    assert {r["status"] for r in again.collect()} == {"ALREADY_IMPORTED"}
    state = TM.runtime_state(ledger).first()
    assert (state["document_count"], state["sample_count"], state["dropped_events"]) == (2, 2, 0)


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc()))
    (tmp_path / "in" / "b.json").write_text("{")
    (tmp_path / "in" / "c.txt").write_text("ignored")
    docs, problems = TM.read_telemetry(spark, str(tmp_path / "in"))
    assert docs.count() == 1 and [r["file"].endswith("b.json") for r in problems.collect()] == [True]
    TM.record_samples(TM.stored_samples(docs.withColumn("server_id", F.lit("s"))), str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert TM.load_samples(stored, metric="m", until="1971-01-01").count() == 1 and TM.load_samples(stored, since="1971-01-01").count() == 0
    files = {r["path"][-5:]: r for r in INV.file_inventory(spark, str(tmp_path / "in")).collect()}
    assert files["c.txt"]["file_type"] == "txt" and files["c.txt"]["size_bytes"] == 7 and len(files["c.txt"]["hash"]) == 64


def test_paths_to_resources(spark):
    paths = ["resources/a/x.lua", "resources/[c]/b/x.lua", "resources/x.lua", "resources/[c]/x.lua", "other/a/x.lua", "alt/q/y"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("r", INV.assign_resource("path", ["resources", "alt"]))
    got = [r["r"] and tuple(r["r"]) for r in df.collect()]
    assert got == [("a", "resources/a", None), ("b", "resources/[c]/b", "[c]"), None, None, None, ("q", "alt/q", None)]


def test_streamed_imports_survive_batches_and_copies(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    raw(spark, doc(), doc()).write.parquet(src)
    stream = lambda: spark.readStream.schema(raw(spark).schema).parquet(src)
    SS.ingest_stream(stream(), out, state).awaitTermination()
    raw(spark, doc(), doc(writtenAt=12), "{").write.mode("append").parquet(src)
    SS.ingest_stream(stream(), out, state).awaitTermination()
    SS.ingest_stream(stream(), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_streamed_states_carry_over(spark, tmp_path):
    src, out, states, check = (str(tmp_path / n) for n in ("src", "out", "states", "check"))
    schema = "id long, resource string, observed_at timestamp, state string"
    put = lambda *rows: spark.createDataFrame([(i, r, None, s) for i, r, s in rows], schema).withColumn(
        "observed_at", F.timestamp_seconds(F.col("id") * 1000)
    ).coalesce(1).write.mode("append").parquet(src)
    run = lambda: SS.state_change_stream(spark.readStream.schema(schema).parquet(src), out, states, check).awaitTermination()
    put((1, "r", "on"), (2, "r", "on"), (3, "q", "off"))
    run()
    put((4, "r", "on"), (500, "r", "off"), (501, "n", "on"))
    run()
    got = {r["id"]: r["kind"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "resource_state", 3: "resource_state", 500: "resource_state_changed", 501: "resource_state"}


def test_numbers_that_do_not_fit_abort_nothing(spark):
    doc = '{"schemaVersion":"1.0","writtenAt":1700000000,"samples":[{"metric":"m","value":%s,"unit":"ms","at":1700000000,"playerCount":%s}],"events":[{"kind":"k","at":%s,"playerCount":1e30}],"dropped":{"samples":%s,"events":1}}'
    raw = spark.createDataFrame(
        [("a.json", "s", doc % ("1.5", "3", "1", "2")), ("b.json", "s", doc % ("1e40", "1e30", "1e40", "1e30")), ("c.json", "s", doc % ("-1e40", "4", "2", "0"))], "file string, server_id string, json string"
    )
    docs = TM.documents(TM.parse(raw))
    samples = {r["value"]: r["player_count"] for r in TM.stored_samples(docs).collect()}
    assert samples == {1.5: 3, 1e40: None, -1e40: 4} and TM.stored_events(docs).count() == 3
    assert len({r["digest"] for r in TM.with_digest(docs).collect()}) == 3
    row = TM.summary(docs).first()
    assert (row["document_count"], row["dropped_samples"], row["dropped_events"]) == (3, 2, 3)
    done = TM.import_documents(raw, spark.createDataFrame([], "server_id string, digest string"))
    assert {r["status"] for r in done.collect()} == {"IMPORTED"}
    ledger = TM.ledger_rows(done, F.current_timestamp())
    more = raw.unionByName(spark.createDataFrame([("d.json", "s", doc % ("2", "3", "1", "2")), ("e.json", "s", (doc % ("1.5", "3", "1", "2")) + " ")], raw.schema))
    again = {r["file"]: r["status"] for r in TM.import_documents(more, ledger).collect()}
    assert again == dict.fromkeys(("a.json", "b.json", "c.json", "e.json"), "ALREADY_IMPORTED") | {"d.json": "IMPORTED"}


def test_stream_states_agree_with_the_batch_form(spark, tmp_path):
    """Late rows and rows without a state, in three batches."""
    from opsdelta.operators.incidents import state_changes

    schema = "id bigint, resource string, observed_at timestamp, state string"
    batches = [[(1, "r", 1000, "on")], [(2, "r", 500, "off"), (3, "r", 1500, None)], [(4, "r", 2000, "on"), (5, "r", 3000, "off")]]
    rows = [[(i, r, F_time(t), s) for i, r, t, s in b] for b in batches]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for b in rows:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        SS.state_change_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    key = lambda df: {(r["id"], r["state"]) for r in df.collect()}
    want = key(state_changes(spark.createDataFrame([x for b in rows for x in b], schema)))
    assert want == {(2, "off"), (1, "on"), (5, "off")} and key(spark.read.parquet(f"{tmp_path}/out")) == want


def F_time(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(seconds)


def test_equal_baseline_times_give_one_label(spark):
    from opsdelta.operators.baselines import claim_samples

    at = F_time(1000)
    samples = spark.createDataFrame([("s", at, at)], "server_id string, sampled_at timestamp, imported_at timestamp")
    for labels in (["b", "a"], ["a", "b"]):
        base = spark.createDataFrame([("s", x, F_time(2000)) for x in labels], "server_id string, label string, created_at timestamp")
        assert [r["baseline_label"] for r in claim_samples(samples, base).collect()] == ["a"]


def test_known_texts_are_settled_by_their_keys(spark, monkeypatch):
    from opsdelta.operators import keyfilter

    files = spark.createDataFrame([(f"f{i}", "s", '{"schemaVersion":"1.0","writtenAt":%d,"samples":[],"events":[]}' % (i % 30)) for i in range(40)], "file string, server_id string, json string")
    empty = spark.createDataFrame([], "server_id string, digest string, raw_digest string")
    first = TM.import_documents(files.where("file < 'f25'"), empty)
    ledger = TM.ledger_rows(first, F.current_timestamp())
    ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    want = None
    for bits in (1 << 24, 1 << 3):  # a filter of eight bits lets nearly every text pass
        monkeypatch.setattr(keyfilter, "BITS", bits)
        got = TM.import_documents(files, ledger)
        status = {r["file"]: r["status"] for r in got.collect()}
        assert len(status) == 40 and (want is None or status == want)
        want = status
        imported = {r["digest"] for r in got.where("status = 'IMPORTED'").collect()} | {r["digest"] for r in ledger.collect()}
        assert len(imported) == 30
        assert TM.import_documents(files, ledger.unionByName(TM.ledger_rows(got, F.current_timestamp()))).where("status = 'IMPORTED'").count() == 0


def test_no_text_is_shuffled_on_import(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("f", "s", "{}")], "file string, server_id string, json string")
        ledger = spark.createDataFrame([("s", "d", "x")], "server_id string, digest string, raw_digest string")
        plan = TM.import_documents(files, ledger)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "json" not in plan
