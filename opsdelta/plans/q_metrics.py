"""Telemetry, statistics, regression and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deterministic_id, format_percentage, iso, lateness, r6, relative_change
from ..operators import baselines as BL
from ..operators import regression as RG
from ..operators import stats as ST
from ..operators.ordered import with_previous
from ..operators.tables import replace_by_key, upsert
from ..session import cut_lineage
from ..sources import inventory as INV
from ..sources import telemetry as TM
from . import views as V
from .registry import duration, fnd, hid, iso_sql, jsr, lanes, pct, query, r6 as r6s, txt  # noqa: F401

NOW = "2024-02-01T00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def parsed(spark, sf):
    return TM.parse(V.raw_documents(spark, sf))


def docs(spark, sf):
    return TM.documents(parsed(spark, sf))


# ------------------------------------------------------------------ sources


@query("telemetry_problems", "select file, reason from v_docs where reason is not null")
def _(spark, sf):
    return TM.problems(parsed(spark, sf))


@query(
    "explode_samples",
    f"select file, metric, {r6s('value')} as value, unit, player_count, {r6s('at_s')} as at_s from v_doc_samples",
)
def _(spark, sf):
    s = TM.explode_samples(docs(spark, sf))
    return s.select("file", "metric", r6("value").alias("value"), "unit", F.col("player_count").cast("bigint").alias("player_count"), r6("at").alias("at_s"))


@query("explode_events", f"select file, kind, resource, detail, {r6s('at_s')} as at_s from v_doc_events")
def _(spark, sf):
    return TM.explode_events(docs(spark, sf)).select("file", "kind", "resource", "detail", r6("at").alias("at_s"))


@query(
    "stored_samples",
    f"""select server_id, '(server)' as resource, metric, {r6s('value')} as value, unit, player_count,
    {iso_sql('ts')} as sampled_at, source from v_doc_samples""",
)
def _(spark, sf):
    s = TM.stored_samples(docs(spark, sf))
    return s.withColumn("value", r6("value")).withColumn("sampled_at", iso("sampled_at"))


@query(
    "stored_events",
    f"select server_id, kind, resource, detail, {iso_sql('ts')} as observed_at, source from v_doc_events",
)
def _(spark, sf):
    e = TM.stored_events(docs(spark, sf)).withColumn("observed_at", iso("observed_at"))
    return e.select("server_id", "kind", "resource", "detail", "observed_at", "source")


SUMMARY = f"""
select (select count(*) from v_docs where reason is null) as document_count,
  (select count(*) from v_doc_samples) as sample_count, (select count(*) from v_doc_events) as event_count,
  {iso_sql("(select min(ts) from (select ts from v_doc_samples union all select ts from v_doc_events))")} as earliest,
  {iso_sql("(select max(ts) from (select ts from v_doc_samples union all select ts from v_doc_events))")} as latest,
  (select coalesce(sum(dropped_samples), 0)::BIGINT from v_docs where reason is null) as dropped_samples,
  (select coalesce(sum(dropped_events), 0)::BIGINT from v_docs where reason is null) as dropped_events"""


def _iso_range(df):
    return df.withColumn("earliest", iso("earliest")).withColumn("latest", iso("latest"))


@query("telemetry_summary", SUMMARY)
def _(spark, sf):
    return _iso_range(TM.summary(docs(spark, sf)))


@query(
    "telemetry_names",
    """select distinct 'METRIC' as role, metric as name from v_doc_samples
    union all select distinct 'RESOURCE', resource from v_doc_events where resource is not null""",
)
def _(spark, sf):
    return TM.observed_names(docs(spark, sf))


@query("document_digest", "select file, digest from v_digests")
def _(spark, sf):
    return TM.with_digest(docs(spark, sf)).select("file", "digest")


FIRST_DAYS = 19732  # 2024-01-10 as a day number: what an earlier import covered


def _day(file):
    return F.split(file, "-")[2].cast("bigint")


def digested(spark, sf):
    return cut_lineage(TM.with_digest(docs(spark, sf)))


def first_days(d):
    return d.where(_day(F.col("file")) < FIRST_DAYS)


def read_again(d):
    """Documents read with a copy of each, after the first days were imported."""
    read = d.unionByName(d.withColumn("file", F.concat(F.lit("copy-"), "file")))
    return TM.ingest_once(read, first_days(d).select("server_id", "digest"))


def ingested(spark, sf):
    return read_again(digested(spark, sf))


READ = """(select * from v_digests union all select * replace ('copy-' || file as file) from v_digests)"""
INGEST = f"""(
select *, case when (server_id, digest) in (select (server_id, digest) from v_digests where day < {FIRST_DAYS}) then 'ALREADY_IMPORTED'
  when file = min(file) over (partition by server_id, digest) then 'IMPORTED' else 'ALREADY_IMPORTED' end as status from {READ})"""


@query("ingest_once", f"select server_id, file, digest, status from {INGEST}")
def _(spark, sf):
    return ingested(spark, sf).select("server_id", "file", "digest", "status")


def _ledger_sql(ingest: str, at: str = "2024-02-01T00:00:00.000Z") -> str:
    return f"""(select server_id, file as path, digest, collector_version, sample_count, event_count, dropped_samples, dropped_events,
  case when written > 0 then {iso_sql('make_timestamp(written * 1000000)')} end as written_at, '{at}' as imported_at
  from {ingest} where status = 'IMPORTED')"""


LEDGER = _ledger_sql(INGEST)
# What the earlier import added, at the end of the first days, and the entries of both imports.
EARLIER = _ledger_sql(f"""(
select *, case when file = min(file) over (partition by server_id, digest) then 'IMPORTED' else 'ALREADY_IMPORTED' end as status
  from v_digests where day < {FIRST_DAYS})""", "2024-01-10T00:00:00.000Z")
WHOLE_LEDGER = f"(select * from {EARLIER} union all select * from {LEDGER})"
# The files taken as different in content: their versions are the same.
BY_FILE = _ledger_sql(f"""(
select server_id, 'copy-' || file as file, digest, case when day < {FIRST_DAYS} then 'ALREADY_IMPORTED' else 'IMPORTED' end as status,
  sample_count, event_count, dropped_samples, dropped_events, written, collector_version from v_digests
union all select server_id, file, digest, 'ALREADY_IMPORTED', sample_count, event_count, dropped_samples, dropped_events, written,
  collector_version from v_digests)""")


def ledger(spark, sf):
    """What the second import added."""
    return TM.ledger_rows(ingested(spark, sf), now())


def whole_ledger(spark, sf):
    """The entries of both imports: of the first days at their end, then of all that is read again."""
    d = digested(spark, sf)
    nothing = d.select("server_id", "digest").limit(0)
    earlier = TM.ledger_rows(TM.ingest_once(first_days(d), nothing), F.timestamp_seconds(F.lit(FIRST_DAYS * 86400)))
    return earlier.unionByName(TM.ledger_rows(read_again(d), now()))


@query("ingest_ledger", f"select * from {LEDGER}")
def _(spark, sf):
    rows = ledger(spark, sf).drop("collector", "schema_version")
    return rows.withColumn("written_at", iso("written_at")).withColumn("imported_at", iso("imported_at"))


@query(
    "runtime_state",
    f"""select server_id, count(*) as document_count, coalesce(sum(sample_count), 0)::BIGINT as sample_count,
    coalesce(sum(event_count), 0)::BIGINT as event_count, coalesce(sum(dropped_samples), 0)::BIGINT as dropped_samples,
    coalesce(sum(dropped_events), 0)::BIGINT as dropped_events, min(imported_at) as first_import, max(imported_at) as last_import,
    max(written_at) as last_written from {WHOLE_LEDGER} group by server_id""",
)
def _(spark, sf):
    s = TM.runtime_state(whole_ledger(spark, sf))
    for c in ("first_import", "last_import", "last_written"):
        s = s.withColumn(c, iso(c))
    return s


@query(
    "collector_versions",
    f"select distinct server_id, collector_version from {BY_FILE} where collector_version is not null",
)
def _(spark, sf):
    return TM.collector_versions(ledger(spark, sf))


@query(
    "dropped_totals",
    """select coalesce(sum(dropped_samples), 0)::BIGINT as dropped_samples, coalesce(sum(dropped_events), 0)::BIGINT as dropped_events
    from v_docs where reason is null""",
)
def _(spark, sf):
    return TM.summary(docs(spark, sf)).select("dropped_samples", "dropped_events")


@query(
    "performance_section",
    f"""select s.*, (select count(*) from v_docs where reason is not null) as unreadable_documents, sample_count > 0 as collected
    from ({SUMMARY}) s""",
)
def _(spark, sf):
    return _iso_range(TM.performance_section(parsed(spark, sf)))


@query(
    "recent_events",
    f"""select event_id as id, 'u' || user_id as server_id, event_type as kind, {iso_sql('ts')} as observed_at from events
    order by ts desc, event_id desc limit 50""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), V.pre("u", "user_id").alias("server_id"), F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("observed_at"),
    )
    return TM.recent_events(e).withColumn("observed_at", iso("observed_at"))


@query(
    "load_samples",
    f"""select resource, {r6s('value')} as value, player_count, {iso_sql('sampled_at')} as sampled_at from v_samples
    where metric = 'qty' and sampled_at >= timestamp '1997-01-01' and sampled_at <= timestamp '1997-12-31'""",
)
def _(spark, sf):
    s = TM.load_samples(V.samples(spark, sf), metric="qty", since="1997-01-01", until="1997-12-31")
    return s.select("resource", r6("value").alias("value"), "player_count", iso("sampled_at").alias("sampled_at"))


_DOC_PATH = "'resources/' || case when doc_id % 3 = 0 then '[' || lang || ']/' else '' end || case when doc_id % 5 = 0 then '' else source || '/' end || doc_id || case when doc_id % 4 = 0 then '.json' else '.lua' end"


@query(
    "file_inventory",
    f"""select path, strlen(text)::BIGINT as size_bytes, sha256(text) as hash, {iso_sql("make_timestamp(1704067200000000 + doc_id * 1000000)")} as modified_at,
    case when path like '%.json' then 'json' else 'lua' end as file_type,
    case when seg[1] like '[%]' then (case when len(seg) >= 3 then seg[2] end) when len(seg) >= 2 then seg[1] end as resource,
    case when seg[1] like '[%]' and len(seg) >= 3 then seg[1] end as category
    from (select *, string_split(substr(path, 11), '/') as seg from (select *, {_DOC_PATH} as path from documents))""",
)
def _(spark, sf):
    """Documents as a table of files."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    files = V.table(spark, sf, "documents").select(F.expr(_DOC_PATH).alias("path"), F.col("text").alias("content"), at.alias("modified_at"))
    return INV.content_inventory(files, ["resources"]).withColumn("modified_at", iso("modified_at"))


@query(
    "assign_resource",
    """select path, case when seg[1] like '[%]' then (case when len(seg) >= 3 then seg[2] end) when len(seg) >= 2 then seg[1] end as resource,
    case when seg[1] like '[%]' then (case when len(seg) >= 3 then 'resources/' || seg[1] || '/' || seg[2] end)
         when len(seg) >= 2 then 'resources/' || seg[1] end as directory,
    case when seg[1] like '[%]' and len(seg) >= 3 then seg[1] end as category
    from (select path, string_split(substr(path, 11), '/') as seg from (
      select 'resources/' || case when doc_id % 3 = 0 then '[' || lang || ']/' else '' end ||
             case when doc_id % 5 = 0 then '' else source || '/' end || doc_id || '.lua' as path from documents))""",
)
def _(spark, sf):
    d = F.col("doc_id")
    path = F.concat(
        F.lit("resources/"),
        F.when(d % 3 == 0, F.concat(F.lit("["), "lang", F.lit("]/"))).otherwise(F.lit("")),
        F.when(d % 5 == 0, F.lit("")).otherwise(F.concat("source", F.lit("/"))),
        V.S(d), F.lit(".lua"),
    )
    rows = V.table(spark, sf, "documents").select(path.alias("path"))
    found = rows.withColumn("r", INV.assign_resource("path", ["resources"]))
    return found.select("path", "r.resource", "r.directory", "r.category")


@query(
    "classify_file",
    """select path, case when ext = '' then 'unknown' when ext = 'lua' then 'lua' when ext in ('js', 'mjs', 'cjs', 'ts') then 'javascript'
    when ext = 'json' then 'json' when ext in ('cfg', 'ini', 'toml', 'yml', 'yaml') then 'config' when ext in ('html', 'css') then 'web'
    when ext in ('dll', 'exe', 'so', 'dylib') then 'binary' else ext end as file_type
    from (select path, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) as ext from v_files_after)""",
)
def _(spark, sf):
    from ..functions import classify_file

    return V.files(spark, sf, "after").select("path", classify_file("path").alias("file_type"))


@query(
    "upsert_resources",
    f"""select coalesce(a.path, b.path) as path, coalesce(a.hash, b.hash) as hash, coalesce(a.size_bytes, b.size_bytes) as size_bytes,
    {iso_sql('coalesce(b.modified_at, a.modified_at)')} as first_seen_at
    from v_files_before b full outer join v_files_after a on a.path = b.path""",
)
def _(spark, sf):
    cols = lambda df: df.select("path", "hash", "size_bytes", F.col("modified_at").alias("first_seen_at"))
    out = upsert(cols(V.files(spark, sf, "before")), cols(V.files(spark, sf, "after")), ["path"], keep_first=["first_seen_at"])
    return out.withColumn("first_seen_at", iso("first_seen_at"))


@query(
    "replace_by_key",
    """select resource, path, hash from v_files_before where coalesce(resource, '') not in
         (select coalesce(resource, '') from v_files_after where hash not in (select hash from v_files_before))
    union all select resource, path, hash from v_files_after where hash not in (select hash from v_files_before)""",
)
def _(spark, sf):
    b = V.files(spark, sf, "before").select(F.coalesce("resource", F.lit("")).alias("resource"), "path", "hash")
    a = V.files(spark, sf, "after").select(F.coalesce("resource", F.lit("")).alias("resource"), "path", "hash")
    arriving = a.join(b.select("hash").distinct(), "hash", "left_anti").select("resource", "path", "hash")
    out = replace_by_key(b, arriving, ["resource"])
    return out.withColumn("resource", F.when(F.col("resource") != "", F.col("resource"))).select("resource", "path", "hash")


@query("report_json")
def _(spark, sf):
    from ..operators import findings as FI
    from ..operators import health as HE

    f = V.findings(spark, sf)
    available = ["PERFORMANCE", "SECURITY", "DEPENDENCIES", "CONFIGURATION"]
    parts = {
        "health": HE.health_score(f, available),
        "resources": f.groupBy("resource").agg(F.count(F.lit(1)).alias("findings")),
        "findings": f.select("id", "rule_id", "severity", "confidence", "title", "resource", "file", "line"),
        "performance": _iso_range(TM.summary(docs(spark, sf))),
        "security": FI.security_section(f),
    }
    return INV.report_sections(parts)


# --------------------------------------------------------------- statistics

STAT_SQL = """count(v) as sample_count, coalesce(avg(v), 0) as mean, coalesce(quantile_cont(v, 0.5), 0) as median,
coalesce(quantile_cont(v, 0.95), 0) as p95, coalesce(min(v), 0) as min, coalesce(max(v), 0) as max, coalesce(stddev_pop(v), 0) as sd"""


def _stats(df, *by):
    cols = ["mean", "median", "p95", "min", "max", "standard_deviation", "coefficient_of_variation"]
    return df.select(*by, "sample_count", *[r6(c).alias(c) for c in cols])


def _stats_sql(source: str, by: str) -> str:
    return f"""select {by}, sample_count, {r6s('mean')} as mean, {r6s('median')} as median, {r6s('p95')} as p95, {r6s('min')} as min,
    {r6s('max')} as max, {r6s('sd')} as standard_deviation,
    {r6s("case when mean = 0 then 0 else sd / mean end")} as coefficient_of_variation
    from (select {by}, {STAT_SQL} from (select *, value::DOUBLE as v from {source}) group by {by})"""


@query("sample_summary", _stats_sql("v_samples", "resource, metric"))
def _(spark, sf):
    return _stats(ST.summarize(V.samples(spark, sf), ["resource", "metric"], "value"), "resource", "metric")


@query(
    "percentiles",
    "select event_type, "
    + ", ".join(f"{r6s(f'quantile_cont(value, {p})')} as p{n}" for n, p in (("01", 0.01), ("25", 0.25), ("50", 0.5), ("95", 0.95), ("99", 0.99)))
    + " from events group by event_type",
)
def _(spark, sf):
    ps = ST.percentiles(V.table(spark, sf, "events"), ["event_type"], "value", [1, 25, 50, 95, 99])
    names = ["p01", "p25", "p50", "p95", "p99"]
    return ps.select("event_type", *[r6(f"p{i}").alias(n) for i, n in enumerate(names)])


REL = "(case when b = 0 and a = 0 then 0.0::DOUBLE when b = 0 then 'Infinity'::DOUBLE else (a - b) / b end)"
DAILY = """(select user_id, coalesce(sum(value) filter (event_type = 'click'), 0)::DOUBLE as b,
  coalesce(sum(value) filter (event_type = 'view'), 0)::DOUBLE as a from events group by user_id, date_trunc('day', ts))"""


def _daily(spark, sf, total=F.sum):
    v = lambda kind: F.coalesce(total(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    return V.table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(v("click").alias("b"), v("view").alias("a"))


@query("relative_change", f"select user_id, case when isinf({REL}) then -99.0::DOUBLE else {r6s(REL)} end as change from {DAILY}")
def _(spark, sf):
    c = relative_change("b", "a")
    return _daily(spark, sf).select("user_id", F.when(c == float("inf"), F.lit(-99.0)).otherwise(r6(c)).alias("change"))


def _exact_sql(v: str) -> str:
    """`stats.exact_sum` of a column of doubles."""
    d = f"try_cast({v} as DECIMAL(28,6))"
    return f"(case when count({d}) = count({v}) then sum({d})::DOUBLE else sum({v}) end)"


DAILY_EXACT = f"""(select user_id, coalesce({_exact_sql('click')}, 0)::DOUBLE as b, coalesce({_exact_sql('seen')}, 0)::DOUBLE as a
  from (select *, case when event_type = 'click' then value end as click, case when event_type = 'view' then value end as seen from events)
  group by user_id, date_trunc('day', ts))"""


@query("format_percentage", f"select user_id, {pct(REL)} as change from {DAILY_EXACT}")
def _(spark, sf):
    return _daily(spark, sf, ST.exact_sum).select("user_id", format_percentage(relative_change("b", "a")).alias("change"))


@query(
    "scheduler_lateness",
    """select event_id as id, user_id, case when prev is null then null else greatest(0, (epoch_us(ts) // 1000 - epoch_us(prev) // 1000) - 60000)::DOUBLE end as lateness_ms
    from (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    p = with_previous(e, ["user_id"], "ts", "event_id", ["ts"])
    elapsed = (F.unix_millis("ts") - F.unix_millis("prev_ts")).cast("double")
    return p.select(F.col("event_id").alias("id"), "user_id", F.when(F.col("prev_ts").isNotNull(), lateness(F.lit(60000.0), elapsed)).alias("lateness_ms"))


# --------------------------------------------------------------- regression

MOMENTS = """(select resource, metric, coalesce(max(unit) filter (side = 'before'), max(unit)) as unit,
  count(*) filter (side = 'before') as bn, count(*) filter (side = 'after') as an,
  coalesce(avg(value) filter (side = 'before'), 0) as bm, coalesce(avg(value) filter (side = 'after'), 0) as am,
  coalesce(stddev_pop(value) filter (side = 'before'), 0) as bs, coalesce(stddev_pop(value) filter (side = 'after'), 0) as sa,
  avg(player_count) filter (side = 'before') as bp, avg(player_count) filter (side = 'after') as ap
  from v_samples group by resource, metric)"""
# the same with `stats.exact_mean`, for text
MOMENTS_EXACT = (
    MOMENTS.replace("avg(value) filter (side = 'before')", f"{_exact_sql('b')} / count(b)")
    .replace("avg(value) filter (side = 'after')", f"{_exact_sql('a')} / count(a)")
    .replace("from v_samples", "from (select *, case when side = 'before' then value end as b, case when side = 'after' then value end as a from v_samples)")
)


def _judged_sql(extra: str = "", moments: str = MOMENTS) -> str:
    return f"""(select *, case when bn < 8 or an < 8 then 'INSUFFICIENT_SAMPLES' {extra}
  when bcv > 0.75 then 'BASELINE_TOO_NOISY' when d < 0 and abs(rel) >= 0.5 then 'IMPROVEMENT' when d < 0.2 and d <= 0 then 'UNCHANGED'
  when d < 0.2 then 'BELOW_ABSOLUTE_THRESHOLD' when rel < 0.5 then 'BELOW_RELATIVE_THRESHOLD' else 'REGRESSION' end as verdict
  from (select *, am - bm as d, case when bm = 0 and am = 0 then 0::DOUBLE when bm = 0 then 'Infinity'::DOUBLE else (am - bm) / bm end as rel,
        case when bm = 0 then 0 else bs / bm end as bcv from {moments}))"""


CONF = (
    "case when verdict in ('REGRESSION', 'IMPROVEMENT') then "
    + jsr(
        "least(0.9::DOUBLE, greatest(0.25::DOUBLE, 0.5::DOUBLE * least(1.0::DOUBLE, abs(d) / greatest(bs, sa, 2.220446049250313e-16::DOUBLE) / 3)"
        " + 0.3::DOUBLE * least(1.0::DOUBLE, least(bn, an) / 60.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, abs(rel) / 2)))",
        2,
    )
    + " else 0.0::DOUBLE end"
)


def judged(spark, sf, t=RG.Thresholds()):
    return RG.judge(RG.compare_windows(V.samples(spark, sf)), t)


@query(
    "window_compare",
    f"""select resource, metric, {", ".join(f"coalesce(max({c}) filter (side = '{t}'), 0) as {t}_{c}" for t in ("before", "after") for c in ("sample_count", "mean", "median", "p95", "min", "max", "standard_deviation", "coefficient_of_variation"))}
    from ({_stats_sql("v_samples", "resource, metric, side")}) group by resource, metric""",
)
def _(spark, sf):
    w = RG.window_summaries(V.samples(spark, sf))
    return w.select(
        "resource", "metric",
        *[
            (F.col(f"{t}_{c}") if c == "sample_count" else r6(f"{t}_{c}")).alias(f"{t}_{c}")
            for t in ("before", "after")
            for c in ST.STATS
        ],
    )


@query(
    "regression_verdict",
    f"select resource, metric, bn as before_count, an as after_count, {r6s('d')} as absolute_change, case when isinf(rel) then -99.0::DOUBLE else {r6s('rel')} end as relative_change, verdict from {_judged_sql()}",
)
def _(spark, sf):
    rel = F.col("relative_change")
    return judged(spark, sf).select(
        "resource", "metric", "before_count", "after_count", r6("absolute_change").alias("absolute_change"),
        F.when(rel == float("inf"), F.lit(-99.0)).otherwise(r6(rel)).alias("relative_change"), "verdict",
    )


@query("regression_confidence", f"select resource, metric, verdict, {CONF} as confidence from {_judged_sql()}")
def _(spark, sf):
    return judged(spark, sf).select("resource", "metric", "verdict", "confidence")


MOVED = f"{txt('bm', 3)} || ' to ' || {txt('am', 3)} || ' ' || unit || ' (' || {pct('rel')} || ')'"


@query(
    "regression_explained",
    f"""select resource, metric, case verdict when 'INSUFFICIENT_SAMPLES' then bn || ' and ' || an || ' samples; each side needs 8'
    when 'BASELINE_TOO_NOISY' then 'earlier window varies by ' || {pct('bcv')} || ' of its mean'
    when 'IMPROVEMENT' then metric || ' fell from ' || {MOVED} when 'UNCHANGED' then metric || ' did not rise'
    when 'BELOW_ABSOLUTE_THRESHOLD' then metric || ' rose by ' || {txt('d', 3)} || ' ' || unit || ', under 0.2 ' || unit
    when 'BELOW_RELATIVE_THRESHOLD' then metric || ' rose by ' || {pct('rel')} || ', under +50.00%'
    else metric || ' rose from ' || {MOVED} || ' over ' || bn || ' and ' || an || ' samples' end as explanation from {_judged_sql(moments=MOMENTS_EXACT)}""",
)
def _(spark, sf):
    compared = RG.compare_windows(V.samples(spark, sf), mean=ST.exact_mean)
    return RG.explain_verdict(RG.judge(compared)).select("resource", "metric", "explanation")


@query(
    "regression_findings",
    f"""select {fnd("'PERF-REGRESSION-001'", "resource", "''", "null", "'old->new:' || metric")} as id, resource, metric,
    case when rel >= 1 then 'HIGH' else 'MEDIUM' end as severity, {CONF} as confidence,
    {jsr('bm', 4)} as mean_before, {jsr('am', 4)} as mean_after, {jsr('bcv', 4)} as spread_before from {_judged_sql()} where verdict = 'REGRESSION'""",
)
def _(spark, sf):
    f = RG.regression_findings(judged(spark, sf), "old", "new")
    e = lambda i: F.col("evidence")[i]["value"]
    return f.select("id", "resource", "metric", "severity", "confidence", e(0).alias("mean_before"), e(1).alias("mean_after"), e(2).alias("spread_before"))


@query(
    "performance_compared",
    """select b > 0 and a > 0 as compared, case when b = 0 and a = 0 then 'no samples on either side'
    when b = 0 or a = 0 then 'samples on one side only: ' || b || ' and ' || a end as reason, b as before_rows, a as after_rows
    from (select count(*) filter (side = 'before') as b, count(*) filter (side = 'after') as a from v_samples)""",
)
def _(spark, sf):
    return RG.compared_guard(V.samples(spark, sf))


@query(
    "regression_context",
    f"select resource, metric, {r6s('bp')} as before_players, {r6s('ap')} as after_players, verdict from "
    + _judged_sql("when abs(ap - bp) > 0.2 then 'CONTEXT_MISMATCH'"),
)
def _(spark, sf):
    j = judged(spark, sf, RG.Thresholds(max_player_delta=0.2))
    return j.select("resource", "metric", r6("before_players").alias("before_players"), r6("after_players").alias("after_players"), "verdict")


# ---------------------------------------------------------------- baselines


def claimed(spark, sf):
    return BL.claim_samples(V.samples(spark, sf), V.baselines(spark, sf))


@query(
    "claim_samples",
    f"select server_id, resource, metric, {r6s('value')} as value, {iso_sql('sampled_at')} as sampled_at, baseline_label from v_claimed",
)
def _(spark, sf):
    return claimed(spark, sf).select("server_id", "resource", "metric", r6("value").alias("value"), iso("sampled_at").alias("sampled_at"), "baseline_label")


@query(
    "baseline_header",
    f"""select {hid('bl', 'b.server_id', 'b.label')} as id, b.server_id, b.label, {iso_sql('b.created_at')} as created_at,
    coalesce(r.n, 0) as resource_count, coalesce(f.n, 0) as finding_count, coalesce(s.n, 0) as sample_count
    from v_baselines b left join (select server_id, count(distinct coalesce(resource, '')) as n from v_files_before group by 1) r using (server_id)
    left join (select server_id, count(*) as n from v_findings group by 1) f using (server_id)
    left join (select server_id, baseline_label as label, count(*) as n from v_claimed group by 1, 2) s using (server_id, label)""",
)
def _(spark, sf):
    inv = BL.resource_inventory(V.files(spark, sf, "before"), ["server_id", "resource"])
    h = BL.capture_header(inv, V.findings(spark, sf), claimed(spark, sf), V.baselines(spark, sf))
    return h.withColumn("created_at", iso("created_at"))


INVENTORY = f"""(select resource, count(*) as file_count, sum(size_bytes)::BIGINT as total_bytes,
  {lanes("path || ':' || size_bytes || ':' || hash")} as content_hash from %s group by resource)"""


@query("resource_inventory", f"select * from {INVENTORY % 'v_files_before'}")
def _(spark, sf):
    return BL.resource_inventory(V.files(spark, sf, "before"))


@query(
    "server_fingerprint",
    f"""select {lanes('part')} as server_fingerprint from (select coalesce(resource || ':', '') || file_count as part from {INVENTORY % 'v_files_before'}
    union all select 'config:' || coalesce(sum(length(text)), 0) from conversations)""",
)
def _(spark, sf):
    return BL.server_fingerprint(BL.resource_inventory(V.files(spark, sf, "before")), V.table(spark, sf, "conversations"))


DIFF_RES = f"""(select coalesce(a.resource, b.resource) as resource, b.resource is null as no_b, a.resource is null as no_a,
  b.content_hash as bh, a.content_hash as ah, b.file_count as bc, a.file_count as ac, b.total_bytes as bb, a.total_bytes as ab,
  b.version as bv, a.version as av from
  (select coalesce(resource, 'root') as resource, file_count, total_bytes, content_hash, null as version from {INVENTORY % 'v_files_before'}) b
  full outer join (select coalesce(resource, 'root') as resource, file_count, total_bytes, content_hash,
     'v' || (file_count % 3) as version from {INVENTORY % 'v_files_after'}) a on a.resource = b.resource)"""


def resource_diff(spark, sf):
    root = lambda df: df.withColumn("resource", F.coalesce("resource", F.lit("root")))
    b = root(BL.resource_inventory(V.files(spark, sf, "before"))).withColumn("version", F.lit(None).cast("string"))
    a = root(BL.resource_inventory(V.files(spark, sf, "after"))).withColumn("version", V.pre("v", F.col("file_count") % 3))
    return BL.diff_resources(b, a)


@query(
    "diff_resources",
    f"""select resource, case when no_b then 'ADDED' when no_a then 'REMOVED' when details = '' then 'UNCHANGED' else 'MODIFIED' end as kind, details
    from (select *, case when no_b then 'only in the later one' when no_a then 'only in the earlier one' else concat_ws('; ',
      case when bh <> ah then 'contents changed' end, case when bc <> ac then 'file count ' || bc || ' -> ' || ac end,
      case when bb <> ab then 'bytes ' || bb || ' -> ' || ab end,
      case when bv is distinct from av then 'version ' || coalesce(bv, 'none') || ' -> ' || coalesce(av, 'none') end) end as details from {DIFF_RES})""",
)
def _(spark, sf):
    return resource_diff(spark, sf).withColumn("details", F.array_join("details", "; "))


def finding_sets(spark, sf):
    """Findings before and after the split date, keyed by what they say."""
    f = V.findings(spark, sf).select(
        deterministic_id("fnd", "rule_id", "resource", "title").alias("finding_id"), "rule_id", "severity", "resource", "title",
        (F.col("created_at") >= F.lit(V.SPLIT).cast("timestamp")).alias("late"),
    )
    pick = lambda half: f.where(F.col("late") == F.lit(half)).groupBy("finding_id").agg(
        *[F.min(c).alias(c) for c in ("rule_id", "severity", "resource", "title")]
    )
    return pick(False), pick(True)


FSET = f"""(select {hid('fnd', 'rule_id', 'resource', 'title')} as finding_id, min(rule_id) as rule_id, min(severity) as severity,
  min(resource) as resource, min(title) as title from v_findings where (created_at >= timestamp '1998-06-01') = %s group by 1)"""


@query(
    "diff_findings",
    f"""select finding_id, rule_id, severity, resource, title, 'INTRODUCED' as kind from {FSET % 'true'} where finding_id not in (select finding_id from {FSET % 'false'})
    union all select finding_id, rule_id, severity, resource, title, 'RESOLVED' from {FSET % 'false'} where finding_id not in (select finding_id from {FSET % 'true'})""",
)
def _(spark, sf):
    return BL.diff_findings(*finding_sets(spark, sf))


def headers(spark, sf):
    f = V.findings(spark, sf)

    def side(half):
        return (
            f.where((F.col("created_at") >= F.lit(V.SPLIT).cast("timestamp")) == F.lit(half))
            .groupBy("server_id")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("c"))
            .select(
                "server_id",
                F.when(F.col("server_id") != "srv3", BL.config_fingerprint(V.S("n"))).alias("config_fingerprint"),
                F.when(F.col("server_id") != "srv2", F.col("c")).alias("health_score"),
            )
        )

    return BL.compare_headers(side(False), side(True))


HEAD = """(select server_id, case when server_id <> 'srv3' then sha256(count(*)::VARCHAR) end as cf,
  case when server_id <> 'srv2' then count(*) filter (severity = 'CRITICAL') end as h from v_findings where (created_at >= timestamp '1998-06-01') = %s group by server_id)"""


@query(
    "baseline_compare_header",
    f"select b.server_id, coalesce(b.cf <> a.cf, false) as config_changed, a.h - b.h as health_delta from {HEAD % 'false'} b join {HEAD % 'true'} a using (server_id)",
)
def _(spark, sf):
    return headers(spark, sf)


@query("list_baselines", f"select server_id, label, {iso_sql('created_at')} as created_at from v_baselines")
def _(spark, sf):
    return BL.list_baselines(V.baselines(spark, sf)).withColumn("created_at", iso("created_at"))


@query(
    "baseline_details",
    f"""select resource, metric, {r6s('value')} as value, {iso_sql('sampled_at')} as sampled_at from v_claimed
    where baseline_label = 'b1998' and server_id = (select min(server_id) from v_baselines)""",
)
def _(spark, sf):
    first = V.baselines(spark, sf).agg(F.min("server_id").alias("s")).first()["s"]  # one value
    rows = BL.baseline_details(claimed(spark, sf), first, "b1998", ["resource", "metric", "sampled_at"])
    return rows.select("resource", "metric", r6("value").alias("value"), iso("sampled_at").alias("sampled_at"))


@query(
    "delete_baseline",
    """select server_id, baseline_label, count(*) as sample_count from v_claimed
    where baseline_label is null or baseline_label <> 'b1998' group by 1, 2""",
)
def _(spark, sf):
    gone = V.baselines(spark, sf).where(F.col("label") == "b1998")
    return BL.delete_baseline(claimed(spark, sf), gone).groupBy("server_id", "baseline_label").agg(F.count(F.lit(1)).alias("sample_count"))


def flagship(spark, sf):
    """Claim samples to baselines, then judge the 1998 window against the 1999 one."""
    side = F.when(F.col("baseline_label") == "b1998", "before").when(F.col("baseline_label") == "b1999", "after")
    windows = claimed(spark, sf).withColumn("side", side)
    return RG.explain_verdict(RG.judge(RG.compare_windows(windows)))


@query(
    "baseline_regressions",
    f"select resource, metric, bn as before_count, an as after_count, {r6s('bm')} as before_mean, {r6s('am')} as after_mean, verdict, {CONF} as confidence from "
    + _judged_sql().replace("from v_samples", """from (select * replace (case baseline_label when 'b1998' then 'before' when 'b1999' then 'after' end as side)
       from v_claimed where baseline_label in ('b1998', 'b1999'))"""),
)
def _(spark, sf):
    return flagship(spark, sf).select(
        "resource", "metric", "before_count", "after_count", r6("before_mean").alias("before_mean"), r6("after_mean").alias("after_mean"), "verdict", "confidence"
    )
