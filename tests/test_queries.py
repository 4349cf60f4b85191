"""Registered queries against their SQL twins, and house rules.

The driver checks every query; here a quick selection runs unless
OPSDELTA_ALL_QUERIES is set.
"""

import os
import re

import pytest
from harness import compare, duck

from opsdelta.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUICK = "ingest_once window_compare baseline_regressions diff_snapshots incidents resource_health resolve_edges missing_files redact_documents stream_sessions".split()
NAMES = list(QUERIES) if os.environ.get("OPSDELTA_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries()) and len(QUERIES) > 120
    assert set(QUERIES) - set(ORACLES) == {"report_json"}
    assert entry.entry(spark).count() > 0


def sources():
    for base, _, names in os.walk(os.path.join(ROOT, "opsdelta")):
        if os.path.basename(base) == "llm":  # has tests of its own
            continue
        for n in names:
            if n.endswith(".py"):
                yield os.path.join(base, n), open(os.path.join(base, n)).read()


def test_no_local_lineage_cuts_collects_or_row_udfs():
    for path, text in sources():
        assert not re.search(r"localCheckpoint|\.toPandas\(|\.collect\(\)|F\.udf\(|crossJoin", text), path


def test_plans_push_filters_and_prune_columns(spark):
    from opsdelta.plans import views as V
    from opsdelta.sources.telemetry import load_samples

    plan = load_samples(V.samples(spark, SF), since="1999-01-01").select("value")._jdf.queryExecution().toString()
    schema = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "l_comment" not in schema and "l_tax" not in schema and "PushedFilters: [IsNotNull(l_shipdate)" in plan


def test_correlation_never_nests_loops(spark):
    plans = [QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in ("correlate", "proximity_pairs", "enclosing_interval", "claim_samples")]
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def _with_events(folder, sql):
    """The small tables with other `events`; their path and a DuckDB connection."""
    import duckdb

    for n in os.listdir(SF):
        if n != "events.parquet":
            os.symlink(f"{SF}/{n}", folder / n)
    duckdb.sql(sql.format(events=f"'{SF}/events.parquet'")).write_parquet(str(folder / "events.parquet"))
    return str(folder), duck(str(folder))


@pytest.mark.parametrize("name", ["ingest_once", "ingest_ledger", "runtime_state"])
def test_equal_content_in_other_files_is_imported_once(spark, tmp_path, name):
    copies = "select * replace (event_id + 100000 * i as event_id) from {events}, (select unnest(range(3)) as i)"
    sf, con = _with_events(tmp_path, copies)
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_the_runtime_state_counts_what_an_earlier_import_covered(spark, tmp_path):
    from opsdelta.plans import q_metrics as QM
    from opsdelta.sources import telemetry as TM

    want = {}
    for r in TM.with_digest(QM.docs(spark, SF)).collect():
        want.setdefault(r["server_id"], {})[r["digest"]] = len(r["samples"]), len(r["events"])
    got = {r["server_id"]: r for r in QUERIES["runtime_state"](spark, SF).collect()}
    counts = {s: (r["document_count"], r["sample_count"], r["event_count"]) for s, r in got.items()}
    assert counts == {s: (len(d), *map(sum, zip(*d.values()))) for s, d in want.items()}
    assert {(r["first_import"][:10], r["last_import"][:10]) for r in got.values()} == {("2024-01-10", "2024-02-01")}
    # documents without samples and events are equal on days without a time of writing: two files, one import
    rows = "select e.* replace (99 * n.i as event_id, 4 as user_id, n.t as ts) from (select * from {events} limit 1) e, "
    sf, con = _with_events(tmp_path, rows + "(values (1, timestamp '2024-01-08'), (2, timestamp '2024-01-13')) n(i, t)")
    state = QUERIES["runtime_state"](spark, sf)
    assert [(r["document_count"], r["last_import"][:10]) for r in state.collect()] == [(1, "2024-01-10")]
    assert compare(state, con, ORACLES["runtime_state"]) is None


def test_percentages_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    # added up as doubles in this order the change rounds to +934.38%
    rows = [("click", v) for v in (3.9, 7.31, 6.71)] + [("view", v) for v in (84.02, 29.32, 72.02)]
    values = ", ".join(f"({i}, '{kind}', {v}::DOUBLE)" for i, (kind, v) in enumerate(rows))
    sf, con = _with_events(tmp_path, "select e.* replace (n.i as event_id, 1 as user_id, n.kind as event_type, n.v as value) from "
                           f"(select * from {{events}} limit 1) e, (values {values}) n(i, kind, v) order by n.i")
    df = QUERIES["format_percentage"](spark, sf)
    assert [r["change"] for r in df.collect()] == ["+934.37%"] and compare(df, con, ORACLES["format_percentage"]) is None


def test_a_streamed_batch_has_a_file_for_every_core(spark, monkeypatch):
    from opsdelta.plans import q_streams as QS

    seen, read = [], QS.SS.read_files_stream

    def watched(session, folder, max_files):
        seen.append((max_files, len([n for n in os.listdir(folder) if n.endswith(".parquet")])))
        return read(session, folder, max_files)

    monkeypatch.setattr(QS.SS, "read_files_stream", watched)
    assert QUERIES["stream_ingest_rows"](spark, SF).count() > 0
    cores = spark.sparkContext.defaultParallelism
    assert seen[0][0] >= cores and seen[0][1] > 2 * cores
