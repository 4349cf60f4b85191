"""Streaming queries: the whole table arrives as a stream, results are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iso, r6
from ..session import staging_path
from ..streaming import streams as SS
from . import q_changes as QC
from . import views as V
from .registry import iso_sql, query, r6 as r6s


def events(spark, sf):
    return SS.read_table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_DIGEST = """sha256(array_to_string(list_sort(list_filter([
  'collector:probe', 'version:' || coalesce(case when user_id % 4 <> 0 then '1.' || (user_id % 3) end, ''), 'schema:1.0',
  'written:' || cast(case when day % 5 = 0 then 0 else day * 86400 + 86399 end as DECIMAL(38,6)), 'uptime:' || cast(user_id * 1000 as DECIMAL(38,6)),
  case when event_id % 9 <> 0 then 's:' || event_type || ':' || cast(value as DECIMAL(38,6)) || ':ms:' || cast(at_s as DECIMAL(38,6)) || ':' ||
    coalesce(case when event_id % 4 <> 0 then cast(cast(k as DECIMAL(38,6)) as VARCHAR) end, '') end,
  case when event_id % 11 <> 0 then 'e:' || event_type || ':' || case when event_type <> 'view' then 'r' || (k % 5) else '' end || ':k=' || k || ':' || cast(at_s as DECIMAL(38,6)) end
  ], lambda x: x is not null)), ' ') || ' ')"""


@query(
    "stream_ingest",
    f"""select server_id, min('a' || event_id) as path, digest, any_value(case when event_id % 9 <> 0 then 1 else 0 end)::BIGINT as sample_count,
    any_value(case when event_id % 11 <> 0 then 1 else 0 end)::BIGINT as event_count from (select *, {_DIGEST} as digest from v_doc_rows where user_id % 7 > 3) group by server_id, digest""",
)
def _(spark, sf):
    raw = V.event_documents(events(spark, sf))
    path = staging_path(spark, "ledger")
    SS.ingest_stream(raw, path, staging_path(spark, "ledger-state")).awaitTermination()
    return spark.read.parquet(path).select("server_id", "path", "digest", "sample_count", "event_count")


BATCHES = 3


@query(
    "stream_ingest_rows",
    f"""select server_id, sum(sample_count)::BIGINT as samples, sum(event_count)::BIGINT as events from (
      select server_id, digest, any_value(case when event_id % 9 <> 0 then 1 else 0 end) as sample_count, any_value(case when event_id % 11 <> 0 then 1 else 0 end) as event_count
      from (select *, {_DIGEST} as digest from v_doc_rows where user_id % 7 > 3) group by server_id, digest) group by server_id having sum(sample_count) + sum(event_count) > 0""",
)
def _(spark, sf):
    """Stored samples and events of a stream that arrives in several batches."""
    files = staging_path(spark, "event-files")
    each = max(2, spark.sparkContext.defaultParallelism)  # files a batch: one task reads a file
    V.table(spark, sf, "events").repartition(BATCHES * each, "event_id").write.parquet(files)
    stream = SS.read_files_stream(spark, files, each).withColumn("ts", F.col("ts").cast("timestamp"))
    ledger, samples, rows = (staging_path(spark, n) for n in ("ledger", "samples", "event-rows"))
    SS.ingest_stream(V.event_documents(stream), ledger, staging_path(spark, "ledger-state"), None, samples, rows).awaitTermination()
    counted = lambda path, n: spark.read.parquet(path).select("server_id", F.lit(n).alias("n"))
    both = counted(samples, 0).unionByName(counted(rows, 1))
    return both.groupBy("server_id").agg(F.count_if(F.col("n") == 0).alias("samples"), F.count_if(F.col("n") == 1).alias("events"))


@query("stream_dedupe", "select distinct 'srv' || (user_id % 4) as server_id, sha256(event_type || props) as digest from events")
def _(spark, sf):
    docs = events(spark, sf).select(
        V.pre("srv", F.col("user_id") % 4).alias("server_id"), F.sha2(F.concat("event_type", "props"), 256).alias("digest"), "ts"
    )
    return SS.run_to_table(SS.dedupe(docs, "ts", "1 hour").select("server_id", "digest"), "dedupe")


CLOSED = "(select time_bucket(interval 1 hour, ts) as w, event_type, value from events)"


@query(
    "stream_window_stats",
    f"""select {iso_sql('w')} as window_start, event_type, count(*) as sample_count, {r6s('avg(value)')} as mean, {r6s('quantile_cont(value, 0.5)')} as median,
    {r6s('quantile_cont(value, 0.95)')} as p95, {r6s('min(value)')} as min, {r6s('max(value)')} as max, {r6s('stddev_pop(value)')} as standard_deviation
    from {CLOSED} group by w, event_type having w + interval 1 hour <= (select max(ts) from events) - interval 10 minute""",
)
def _(spark, sf):
    s = events(spark, sf).select("event_type", "value", F.col("ts").alias("sampled_at"))
    stats = SS.window_stats(s, ["event_type"], "1 hour", "10 minutes")
    out = SS.run_to_table(stats, "windows")
    cols = ["mean", "median", "p95", "min", "max", "standard_deviation"]
    return out.select(iso("window_start").alias("window_start"), "event_type", "sample_count", *[r6(c).alias(c) for c in cols])


def signal_stream(spark, sf):
    """The signals view over a stream of the events table."""
    return V.as_signals(events(spark, sf))


@query("stream_correlate", f"select server_id, change_id, effect_id, delta_ms, confidence from {QC.LINKS}")
def _(spark, sf):
    links = SS.correlate_stream(signal_stream(spark, sf), QC.WINDOW_MS, "10 minutes")
    out = SS.run_to_table(links.select(F.col("change_server_id").alias("server_id"), "change_id", "effect_id", "delta_ms", "confidence"), "links")
    return out


@query(
    "stream_sessions",
    f"""select server_id, {iso_sql('session_start')} as started_at, {iso_sql('max(occurred_at)')} as last_at, count(*) as event_count from {QC.SESSIONS}
    group by server_id, session_start having max(occurred_at) + interval 6 hour <= (select max(ts) from events) - interval 10 minute""",
)
def _(spark, sf):
    out = SS.run_to_table(SS.session_stream(signal_stream(spark, sf), "6 hours", "10 minutes"), "sessions")
    return out.withColumn("started_at", iso("started_at")).withColumn("last_at", iso("last_at"))


@query(
    "stream_state_changes",
    f"select id, resource, {iso_sql('ts')} as observed_at, state, case when prev is null then 'resource_state' else 'resource_state_changed' end as kind from {QC.STATES}",
)
def _(spark, sf):
    seen = QC.as_observations(events(spark, sf))
    out = staging_path(spark, "states-out")
    SS.state_change_stream(seen, out, staging_path(spark, "states"), staging_path(spark, "states-state")).awaitTermination()
    return spark.read.parquet(out).select("id", "resource", iso("observed_at").alias("observed_at"), "state", "kind")
