"""Snapshot, correlation and incident queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import format_duration, iso
from ..operators import incidents as CO
from ..operators import integrity as IN
from . import q_metrics as M
from . import views as V
from .registry import duration, fnd, hid, iso_sql, jsr, lanes, query

# ---------------------------------------------------------------- integrity


def diff(spark, sf):
    return IN.diff_snapshots(V.files(spark, sf, "before"), V.files(spark, sf, "after"))


@query(
    "snapshot_header",
    f"""select {hid('snap', "'srv0'", "'new'")} as id, 'srv0' as server_id, 'new' as label, count(*) as file_count,
    sum(size_bytes)::BIGINT as total_bytes, {lanes("path || ':' || size_bytes || ':' || hash")} as snapshot_hash from v_files_after""",
)
def _(spark, sf):
    return IN.snapshot_header(V.files(spark, sf, "after"), "srv0", "new")


DETAILS = """case kind when 'ADDED' then 'new file of ' || after_size || ' bytes' when 'DELETED' then 'only in the earlier snapshot'
 when 'TOUCHED' then 'time differs, content is identical' else 'hash ' || substr(bh, 1, 12) || ' -> ' || substr(ah, 1, 12) ||
 case when before_size <> after_size then '; bytes ' || before_size || ' -> ' || after_size else '' end end"""


@query(
    "diff_snapshots",
    f"""select path, kind, resource, {DETAILS} as details, substr(bh, 1, 16) as before_hash, substr(ah, 1, 16) as after_hash
    from v_diff where kind <> 'UNCHANGED'""",
)
def _(spark, sf):
    return diff(spark, sf).withColumn("details", F.array_join("details", "; "))


@query(
    "diff_summary",
    """select *, added_count + deleted_count + modified_count = 0 as identical from (
    select count(*) filter (kind = 'ADDED') as added_count, count(*) filter (kind = 'DELETED') as deleted_count,
    count(*) filter (kind = 'MODIFIED') as modified_count, count(*) filter (kind = 'TOUCHED') as touched_count,
    count(*) filter (kind = 'UNCHANGED') as unchanged_count from v_diff)""",
)
def _(spark, sf):
    return IN.diff_summary(V.files(spark, sf, "before"), V.files(spark, sf, "after"))


@query(
    "changes_by_resource",
    f"""select {fnd("'INT-CHANGE-001'", "case when owner <> '(server root)' then owner end", "''", "null", "'old->new:' || owner")} as id,
    'INT-CHANGE-001' as rule_id, 'INFO' as severity, 1.0::DOUBLE as confidence, case when owner <> '(server root)' then owner end as resource,
    owner || ': ' || added || ' added, ' || modified || ' modified, ' || deleted || ' deleted' as summary, added, modified, deleted
    from (select coalesce(resource, '(server root)') as owner, count(*) filter (kind = 'ADDED') as added,
      count(*) filter (kind = 'MODIFIED') as modified, count(*) filter (kind = 'DELETED') as deleted
      from v_diff where kind in ('ADDED', 'DELETED', 'MODIFIED') group by 1)""",
)
def _(spark, sf):
    return IN.changes_by_resource(diff(spark, sf), "old", "new")


@query(
    "change_evidence",
    """select owner, position, kind, path, before_hash, after_hash from (select coalesce(resource, '(server root)') as owner, kind, path,
    substr(bh, 1, 16) as before_hash, substr(ah, 1, 16) as after_hash,
    row_number() over (partition by coalesce(resource, '(server root)') order by case kind when 'ADDED' then 0 when 'DELETED' then 1 else 2 end, path) as position
    from v_diff where kind in ('ADDED', 'DELETED', 'MODIFIED')) where position <= 25""",
)
def _(spark, sf):
    return IN.change_evidence(diff(spark, sf))


@query(
    "list_snapshots",
    f"""select {hid('snap', 'server_id', 'label')} as id, label, {iso_sql('created_at')} as created_at from (
    select distinct 'srv' || (o_custkey % 4) as server_id, 'day' || cast(o_orderdate as DATE) as label, date_trunc('day', o_orderdate) as created_at
    from orders) order by created_at desc, 1 limit 20""",
)
def _(spark, sf):
    from ..functions import deterministic_id

    days = V.table(spark, sf, "orders").select(
        V.pre("srv", F.col("o_custkey") % 4).alias("server_id"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("created_at")
    ).distinct()
    label = V.pre("day", F.to_date("created_at"))
    snaps = days.select(deterministic_id("snap", "server_id", label).alias("id"), label.alias("label"), "created_at")
    return IN.list_snapshots(snaps).withColumn("created_at", iso("created_at"))


# -------------------------------------------------------------- correlation

WINDOW_MS = 6 * 3600 * 1000

LINKS = f"""(select *, {jsr(f'''least(0.85::DOUBLE, greatest(0.05::DOUBLE, 0.2::DOUBLE + case when same then 0.35::DOUBLE else 0 end
  + case when delta_ms >= 0 then 0.3::DOUBLE * (1 - delta_ms::DOUBLE / {WINDOW_MS}) else -0.1::DOUBLE end
  + case when change_kind = 'CONFIG_CHANGED' then 0.05::DOUBLE else 0 end))''', 2)} as confidence from (
  select c.server_id, c.id as change_id, c.kind as change_kind, c.resource as change_resource, c.description as change_description,
    e.id as effect_id, e.kind as effect_kind, e.resource as effect_resource, e.description as effect_description, e.ms - c.ms as delta_ms,
    coalesce(c.resource = e.resource, false) as same
  from v_signals c join v_signals e on c.server_id = e.server_id and e.ms - c.ms between -{WINDOW_MS} and {WINDOW_MS}
  where c.kind in ('RESOURCE_CHANGED', 'RESOURCE_ADDED', 'RESOURCE_REMOVED', 'CONFIG_CHANGED', 'RESOURCE_RESTART')
    and e.kind in ('PERFORMANCE_REGRESSION', 'FINDING_INTRODUCED', 'HEALTH_DROP', 'ERROR_SPIKE', 'HITCH')))"""

BEST = f"""(select * from (select *, row_number() over (partition by server_id, effect_id order by confidence desc, delta_ms, change_id) as rn
  from {LINKS}) where rn = 1)"""


@query(
    "signal_roles",
    """select id, kind, case when kind in ('RESOURCE_CHANGED', 'RESOURCE_ADDED', 'CONFIG_CHANGED') then 'CHANGE'
    when kind in ('PERFORMANCE_REGRESSION', 'ERROR_SPIKE') then 'EFFECT' else 'NEITHER' end as role from v_signals""",
)
def _(spark, sf):
    return V.signals(spark, sf).select("id", "kind", CO.signal_role().alias("role"))


@query("correlate", f"select server_id, change_id, effect_id, delta_ms from {LINKS}")
def _(spark, sf):
    return CO.correlate(V.signals(spark, sf), WINDOW_MS).select("server_id", "change_id", "effect_id", "delta_ms")


@query("link_confidence", f"select change_id, effect_id, confidence from {LINKS}")
def _(spark, sf):
    return CO.correlate(V.signals(spark, sf), WINDOW_MS).select("change_id", "effect_id", "confidence")


@query(
    "link_reasons",
    f"""select change_id, effect_id, concat_ws('; ', case when change_resource = effect_resource then 'both concern ' || change_resource
      when change_resource is not null and effect_resource is not null then 'different resources: ' || change_resource || ' and ' || effect_resource end,
    case when delta_ms = 0 then 'same timestamp' when delta_ms > 0 then 'effect came ' || {duration('delta_ms')} || ' after the change'
      else 'effect came ' || {duration('(-delta_ms)')} || ' before the change, weaker evidence' end,
    case when change_kind = 'CONFIG_CHANGED' then 'a configuration change concerns the whole server' end) as reasons from {LINKS}""",
)
def _(spark, sf):
    links = CO.correlate(V.signals(spark, sf), WINDOW_MS)
    return links.select("change_id", "effect_id", F.array_join(CO.link_reasons(), "; ").alias("reasons"))


@query("strongest_links", f"select server_id, effect_id, change_id, delta_ms, confidence from {BEST}")
def _(spark, sf):
    best = CO.strongest_links(V.signals(spark, sf), WINDOW_MS)
    return best.select("server_id", "effect_id", "change_id", "delta_ms", "confidence")


@query(
    "top_links",
    f"select change_id, effect_id, delta_ms, confidence from {LINKS} order by confidence desc, delta_ms, change_id, effect_id limit 100",
)
def _(spark, sf):
    links = CO.link_order(CO.correlate(V.signals(spark, sf), WINDOW_MS)).limit(100)
    return links.select("change_id", "effect_id", "delta_ms", "confidence")


@query(
    "format_duration",
    f"""select id, {duration('gap')} as gap from (select id, ms - lag(ms) over (partition by server_id order by ms, id) as gap from v_signals) where gap is not null""",
)
def _(spark, sf):
    from ..operators.ordered import with_previous

    p = with_previous(V.signals(spark, sf), ["server_id"], "occurred_at", "id", ["occurred_at"])
    gap = F.unix_millis("occurred_at") - F.unix_millis("prev_occurred_at")
    return p.where(F.col("prev_occurred_at").isNotNull()).select("id", format_duration(gap).alias("gap"))


SESSIONS = f"""(select *, max(start_at) over (partition by server_id order by occurred_at rows unbounded preceding) as session_start from (
  select *, case when prev is null or ms - prev > {WINDOW_MS} then occurred_at end as start_at from (
    select *, lag(ms) over (partition by server_id order by occurred_at, id) as prev from v_signals)))"""


@query("sessionize", f"select id, server_id, {iso_sql('session_start')} as session_start from {SESSIONS}")
def _(spark, sf):
    s = CO.sessions(V.signals(spark, sf), WINDOW_MS)
    return s.select("id", "server_id", iso("session_start").alias("session_start"))


INCIDENTS = f"""(select {hid('inc', 's.server_id', "epoch_us(s.session_start) // 1000")} as id, s.server_id, s.session_start as started_at,
  case when s.last_at <> s.session_start then s.last_at end as ended_at,
  case when regression and confidence >= 0.6 then 'HIGH' when regression then 'MEDIUM' else 'LOW' end as severity, confidence,
  event_count, change_count, effect_count, change_id, effect_id, delta_ms, change_resource, effect_resource, change_description, effect_description
  from (select server_id, session_start, max(occurred_at) as last_at, count(*) as event_count, bool_or(kind = 'PERFORMANCE_REGRESSION') as regression,
     count(*) filter (kind like 'RESOURCE%' or kind = 'CONFIG_CHANGED') as change_count,
     count(*) filter (kind like 'PERFORMANCE%' or kind in ('HEALTH_DROP', 'FINDING_INTRODUCED')) as effect_count
     from {SESSIONS} group by server_id, session_start) s
  join (select * from (select l.*, x.session_start, row_number() over (partition by l.server_id, x.session_start
       order by l.confidence desc, l.delta_ms, l.change_id, l.effect_id) as r from {LINKS} l join {SESSIONS} x on x.id = l.effect_id) where r = 1) b
  on b.server_id = s.server_id and b.session_start = s.session_start)"""


def incidents(spark, sf):
    return CO.build_incidents(V.signals(spark, sf), WINDOW_MS)


@query(
    "incidents",
    f"""select id, server_id, {iso_sql('started_at')} as started_at, {iso_sql('ended_at')} as ended_at, confidence, event_count, change_id, effect_id,
    delta_ms from {INCIDENTS}""",
)
def _(spark, sf):
    i = incidents(spark, sf)
    return i.select("id", "server_id", iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"), "confidence", "event_count", "change_id", "effect_id", "delta_ms")


@query("incident_severity", f"select id, severity, confidence from {INCIDENTS}")
def _(spark, sf):
    return incidents(spark, sf).select("id", "severity", "confidence")


@query(
    "incident_summary",
    f"""select id, change_count, effect_count, change_count || ' change(s) and ' || effect_count || ' effect(s) in one window; ' || effect_description ||
    ' was seen ' || case when delta_ms >= 0 then {duration('delta_ms')} || ' after ' else 'before ' end || lower(change_description) ||
    '. Related in time, not shown to be the cause.' as summary,
    coalesce('Inspect what changed in ' || coalesce(change_resource, effect_resource) || ' in this window.', 'Review what changed on the server in this window.') as recommendation
    from {INCIDENTS}""",
)
def _(spark, sf):
    return incidents(spark, sf).select("id", "change_count", "effect_count", "summary", "recommendation")


@query(
    "affected_resources",
    f"select distinct server_id, {iso_sql('session_start')} as session_start, resource from {SESSIONS} where resource is not null",
)
def _(spark, sf):
    return CO.affected_resources(V.signals(spark, sf), WINDOW_MS).withColumn("session_start", iso("session_start"))


TIMELINE = f"""(select i.id as incident_id, s.id as event_id, {iso_sql('s.occurred_at')} as occurred_at, s.kind as event_type, s.resource, s.description,
  f.id as finding_id from {INCIDENTS} i join {SESSIONS} s on s.server_id = i.server_id and s.session_start = i.started_at
  left join v_findings f on f.id = s.finding_id)"""


def timeline(spark, sf):
    t = CO.incident_timeline(V.signals(spark, sf), incidents(spark, sf), V.findings(spark, sf), WINDOW_MS)
    return t.withColumn("occurred_at", iso("occurred_at"))


@query("incident_timeline", f"select * from {TIMELINE}")
def _(spark, sf):
    return timeline(spark, sf)


@query(
    "recent_incidents",
    f"""select n.id as incident_id, {iso_sql('n.started_at')} as started_at, severity, confidence, event_id, occurred_at, event_type, resource, description, finding_id
    from (select * from {INCIDENTS} order by started_at desc, id limit 20) n join {TIMELINE} t on t.incident_id = n.id""",
)
def _(spark, sf):
    recent = CO.recent_incidents(V.signals(spark, sf), incidents(spark, sf), V.findings(spark, sf))
    return recent.withColumn("started_at", iso("started_at")).withColumn("occurred_at", iso("occurred_at"))


AT = "2024-02-01T00:00:00.000Z"


@query(
    "signals_from_comparison",
    f"""select kind, '{AT}' as occurred_at, resource, description, finding_id from (
    select case when no_b then 'RESOURCE_ADDED' when no_a then 'RESOURCE_REMOVED' else 'RESOURCE_CHANGED' end as kind, resource,
      resource || ' ' || case when no_b then 'added' when no_a then 'removed' else 'modified' end as description, null as finding_id
      from {M.DIFF_RES} where no_b or no_a or bh <> ah or bc <> ac or bb <> ab or bv is distinct from av
    union all select 'CONFIG_CHANGED', null, 'server configuration changed', null from {M.HEAD % 'false'} b join {M.HEAD % 'true'} a using (server_id) where b.cf <> a.cf
    union all select 'FINDING_INTRODUCED', resource, 'new finding ' || rule_id || ' (' || title || ')', finding_id from {M.FSET % 'true'}
      where finding_id not in (select finding_id from {M.FSET % 'false'})
    union all select 'PERFORMANCE_REGRESSION', resource, metric || ' regression in ' || resource, null from {M._judged_sql()} where verdict = 'REGRESSION'
    union all select 'HEALTH_DROP', null, 'health score fell by ' || (b.h - a.h) || ' points', null from {M.HEAD % 'false'} b join {M.HEAD % 'true'} a using (server_id) where a.h < b.h)""",
)
def _(spark, sf):
    from ..operators import baselines as BL

    s = CO.signals_from_comparison(
        M.resource_diff(spark, sf), M.headers(spark, sf), BL.diff_findings(*M.finding_sets(spark, sf)), M.judged(spark, sf),
        F.lit("2024-02-01T00:00:00").cast("timestamp"),
    )
    return s.withColumn("occurred_at", iso("occurred_at"))


def observations(spark, sf):
    return as_observations(V.table(spark, sf, "events"))


def as_observations(events):
    return events.select(
        F.col("event_id").alias("id"), V.pre("u", "user_id").alias("resource"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.when(F.col("value") > 20, "started").otherwise("stopped").alias("state"),
    )


STATES = """(select event_id as id, 'u' || user_id as resource, ts, state, prev from (select *, lag(state) over (partition by user_id order by ts, event_id) as prev
  from (select *, case when value > 20 then 'started' else 'stopped' end as state from events)) where prev is null or prev <> state)"""


@query(
    "state_changes",
    f"select id, resource, {iso_sql('ts')} as observed_at, state, case when prev is null then 'resource_state' else 'resource_state_changed' end as kind from {STATES}",
)
def _(spark, sf):
    return CO.state_changes(observations(spark, sf)).withColumn("observed_at", iso("observed_at"))
