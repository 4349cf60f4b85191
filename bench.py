"""Times the headline queries and prints one JSON line.

Every query runs over whole tables and its full result is produced (a noop
sink). `telemetry_import` starts from stored documents: parse, digest, check
against the ledger, write samples, events and ledger. Its rate is comparable
with the published import figure; `telemetry_reimport` finds all known.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opsdelta.plans import QUERIES  # noqa: E402
from opsdelta.plans import views as V  # noqa: E402
from opsdelta.session import build_session  # noqa: E402
from opsdelta.sources import telemetry as TM  # noqa: E402

HEADLINE = """
telemetry_summary document_digest ingest_once sample_summary percentiles window_compare regression_verdict
baseline_regressions claim_samples resource_inventory diff_resources diff_snapshots changes_by_resource change_evidence
correlate strongest_links sessionize incidents incident_timeline state_changes findings_by_resource top_findings
validate_findings upsert_findings health_score resource_health primary_reasons dependency_edges resolve_edges scc cycles
event_graph ensure_missing missing_files redact_documents scan_secrets obfuscation_score proximity_pairs enclosing_interval
hot_events retention_dry_run rule_registry stream_window_stats stream_correlate
""".split()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "opsdelta-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = os.environ.get("BENCH_ONLY", "").split()
    times: dict[str, float] = {}
    drain(QUERIES["severity_counts"](spark, sf))  # start the workers

    work = tempfile.mkdtemp(prefix="spark-bench-")
    V.buffer_documents(spark, sf).repartitionByRange(int(cpus), "file").write.parquet(f"{work}/raw")
    raw = spark.read.parquet(f"{work}/raw")
    empty = spark.createDataFrame([], "server_id string, digest string")

    def load(ledger, out: str) -> None:
        new = TM.import_documents(raw, ledger).where("status = 'IMPORTED'").cache()
        TM.ledger_rows(new, F.current_timestamp()).write.parquet(f"{out}/ledger")
        TM.stored_samples(new).write.parquet(f"{out}/samples")
        TM.stored_events(new).write.parquet(f"{out}/events")
        new.unpersist()

    rates = {}
    if not only or "telemetry_import" in only:
        load(empty, f"{work}/warm")
        times["telemetry_import"] = timed(lambda: load(empty, f"{work}/first"))
        ledger = spark.read.parquet(f"{work}/first/ledger")
        times["telemetry_reimport"] = timed(lambda: load(ledger, f"{work}/second"))
        rows = spark.read.parquet(f"{work}/first/samples").count() + spark.read.parquet(f"{work}/first/events").count()
        rates = {"telemetry_rows": rows, "telemetry_rows_per_sec": round(rows / times["telemetry_import"])}
    small, growth = "/root/testdata/sf0.01", {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        first = timed(lambda: drain(QUERIES[name](spark, small)))  # also compiles the query's code
        times[name] = timed(lambda: drain(QUERIES[name](spark, sf)))
        growth[name] = round(times[name] / first, 2)
        print(name, first, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "times_sf0.01": growth,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                **rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
