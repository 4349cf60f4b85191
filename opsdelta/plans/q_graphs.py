"""Dependency, event and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import configs as CF
from ..operators import graph as GR
from . import views as V
from .registry import fnd, hid, query  # noqa: F401


def edges(spark, sf):
    return GR.build_edges(V.dependencies(spark, sf), V.references(spark, sf))


def provided(spark, sf):
    return GR.providers(V.provides(spark, sf))


def resolved(spark, sf):
    return GR.resolve_edges(edges(spark, sf), V.nodes(spark, sf), provided(spark, sf))


@query("dependency_edges", 'select "from", "to", kind, line from v_edges')
def _(spark, sf):
    return edges(spark, sf)


@query("runtime_constraints", "select 'n' || p as resource, '/server:' || (p % 5) as \"constraint\", p % 50 as line from v_targets")
def _(spark, sf):
    return GR.runtime_constraints(V.dependencies(spark, sf))


@query("providers", "select alias, provider from v_providers")
def _(spark, sf):
    return provided(spark, sf)


@query("resolve_edges", 'select "from", "to", kind, target, resolved from v_resolved')
def _(spark, sf):
    return resolved(spark, sf).select("from", "to", "kind", "target", "resolved")


@query("unresolved_edges", 'select "from", "to", kind, line from v_resolved where not resolved')
def _(spark, sf):
    return GR.unresolved(edges(spark, sf), V.nodes(spark, sf), provided(spark, sf)).select("from", "to", "kind", "line")


@query(
    "dependents",
    "select src as resource, 'DEPENDS_ON' as direction, dst as other from v_arcs union all select dst, 'REQUIRED_BY', src from v_arcs",
)
def _(spark, sf):
    return GR.dependents(resolved(spark, sf))


CYCLES = """with recursive walk as (
  select src as start, dst as last, [src, dst] as path from v_arcs where dst > src
  union all
  select w.start, a.dst, list_append(w.path, a.dst) from walk w join v_arcs a on a.src = w.last
  where a.dst > w.start and not list_contains(w.path, a.dst)),
found as (select array_to_string(w.path, ',') as cycle, len(w.path) as length from walk w join v_arcs a on a.src = w.last and a.dst = w.start
  union all select src, 1 from v_arcs where src = dst)
"""


def cycles(spark, sf):
    return GR.cycles(resolved(spark, sf))


@query("cycles", CYCLES + "select cycle, length::BIGINT as length from found")
def _(spark, sf):
    return cycles(spark, sf).select(F.array_join("cycle", ",").alias("cycle"), "length")


@query(
    "cycle_findings",
    CYCLES
    + f"""select {fnd("'DEP-CYCLE-001'", "string_split(cycle, ',')[1]", "''", "null", "replace(cycle, ',', '>')")} as id, string_split(cycle, ',')[1] as resource,
    'MEDIUM' as severity, 0.9::DOUBLE as confidence, replace(cycle, ',', ' -> ') || ' -> ' || string_split(cycle, ',')[1] as rendered, length::BIGINT as evidence_count from found""",
)
def _(spark, sf):
    c = GR.cycle_findings(cycles(spark, sf))
    return c.select("id", "resource", "severity", "confidence", "rendered", F.size("evidence").cast("bigint").alias("evidence_count"))


@query(
    "shortest_cycles",
    CYCLES
    + """, turned as (select list_concat(c[i:], c[:i - 1]) as c from (select c, unnest(range(1, len(c) + 1)) as i from (select string_split(cycle, ',') as c from found))),
    ways as (select c[1] as "from", c[case when len(c) = 1 then 1 else 2 end] as "to", c, len(c) as length from turned)
    select "from", "to", array_to_string(arg_min(c, {'n': length, 'c': c}), ',') as cycle, min(length)::BIGINT as length from ways group by 1, 2""",
)
def _(spark, sf):
    return GR.shortest_cycles(resolved(spark, sf)).withColumn("cycle", F.array_join("cycle", ","))


@query(
    "scc",
    """with recursive reach as (
      select src, dst from v_arcs union select r.src, a.dst from reach r join v_arcs a on a.src = r.dst),
    names as (select src as name from v_arcs union select dst from v_arcs)
    select n.name, least(n.name, coalesce(min(r.dst), n.name)) as component from names n
    left join reach r on r.src = n.name and exists (select 1 from reach b where b.src = r.dst and b.dst = n.name) group by n.name""",
)
def _(spark, sf):
    return GR.components(resolved(spark, sf))


BUNDLED = "(" + ", ".join(f"'{b}'" for b in fixed.BUNDLED_RESOURCES) + ")"


@query(
    "missing_dependencies",
    f"""select {fnd("'DEP-MISSING-001'", '"from"', "''", "line", "\"to\" || ':' || kind")} as id, 'DEP-MISSING-001' as rule_id,
    case when lower("to") in {BUNDLED} then 'INFO' else 'HIGH' end as severity,
    case when lower("to") in {BUNDLED} then 0.2::DOUBLE when kind = 'DISCOVERED' then 0.85::DOUBLE else 0.95::DOUBLE end as confidence,
    "from" as resource, "to" as dependency, kind, line from v_resolved where not resolved""",
)
def _(spark, sf):
    return GR.missing_dependencies(GR.unresolved(edges(spark, sf), V.nodes(spark, sf), provided(spark, sf)))


@query("event_graph", "select * from v_event_graph")
def _(spark, sf):
    return GR.event_graph(V.event_facts(spark, sf))


@query("event_endpoints", "select event, kind, resource, file, line, call, side from v_event_facts where event is not null")
def _(spark, sf):
    return GR.event_endpoints(V.event_facts(spark, sf))


def named_facts(spark, sf):
    """Facts of events that only some users handle, so that some dangle."""
    f = V.event_facts(spark, sf)
    return f.withColumn("event", F.concat("event", F.lit("/"), "resource"))


NAMED = "(select * replace (event || '/' || resource as event) from v_event_facts)"


@query(
    "dangling_events",
    f"""select event, case when r = 0 then 'NOT_REGISTERED' else 'NOT_TRIGGERED' end as problem from (select event, count(*) filter (kind = 'REGISTRATION') as r,
    count(*) filter (kind = 'TRIGGER') as t from {NAMED} where event is not null group by event) where r = 0 or t = 0""",
)
def _(spark, sf):
    return GR.dangling_events(GR.event_graph(named_facts(spark, sf)))


@query(
    "event_section",
    f"""select count(*) filter (event is not null) as event_count, count(*) filter (event is not null and r = 0) as not_registered,
    count(*) filter (event is not null and t = 0) as not_triggered, count(*) filter (net) as network_events, count(*) filter (bc) as broadcast_events,
    (select count(*) from {NAMED} where event is null) as dynamic_usages
    from (select event, count(*) filter (kind = 'REGISTRATION') as r, count(*) filter (kind = 'TRIGGER') as t,
      bool_or(direction <> 'local') as net, bool_or(broadcast) as bc from {NAMED} where event is not null group by event)""",
)
def _(spark, sf):
    return GR.event_section(named_facts(spark, sf))


@query(
    "event_roles",
    """select distinct event, case when kind = 'REGISTRATION' then 'REGISTERED_BY' else 'TRIGGERED_BY' end as role, resource
    from v_event_facts where event is not null""",
)
def _(spark, sf):
    return GR.event_roles(V.event_facts(spark, sf))


@query(
    "resource_events",
    """select f.resource, f.event, count(*) filter (kind = 'REGISTRATION') as own_registrations, count(*) filter (kind = 'TRIGGER') as own_triggers,
    any_value(g.registrations) as registrations, any_value(g.triggers) as triggers, any_value(g.broadcast) as broadcast, any_value(g.network) as network
    from v_event_facts f join v_event_graph g using (event) group by f.resource, f.event""",
)
def _(spark, sf):
    facts = V.event_facts(spark, sf)
    return GR.resource_events(facts, GR.event_graph(facts))


@query(
    "resource_detail",
    """select n.name, coalesce(o.n, 0) as edges_out, coalesce(o.u, 0) as unresolved_out, coalesce(i.n, 0) as edges_in, coalesce(f.n, 0) as findings, coalesce(e.n, 0) as events_used
    from (select 'n' || p_partkey as name from part) n
    left join (select "from" as name, count(*) as n, count(*) filter (not resolved) as u from v_resolved group by 1) o using (name)
    left join (select target as name, count(*) as n from v_resolved where resolved group by 1) i using (name)
    left join (select 'n' || substr(resource, 2) as name, count(*) as n from v_findings group by 1) f using (name)
    left join (select 'n' || substr(resource, 2) as name, count(distinct event) as n from v_event_facts group by 1) e using (name)""",
)
def _(spark, sf):
    rename = lambda df: df.withColumn("resource", F.concat(F.lit("n"), F.substr("resource", F.lit(2))))
    return GR.resource_detail(V.nodes(spark, sf), resolved(spark, sf), rename(V.findings(spark, sf)), rename(V.event_facts(spark, sf)))


# ------------------------------------------------------------ configuration


@query(
    "config_directives",
    """select file, line, kind, command, target, case when kind = 'DIRECTIVE' then target like '[%]' end as is_category, value from (
      select file, e * 4 + 1 as line, 'DIRECTIVE' as kind, command, target, null as value from lines
      union all select file, e * 4 + 3, 'VARIABLE', 'setr', 'key_' || uid, event_type || ' v ' || e from lines
      union all select file, e * 4 + 4, 'EXEC', 'exec', 'part ' || uid || '.cfg', null from lines)""".replace(
        "select file, line", "with lines as (select 'cfg' || (event_id // 1000) || '.cfg' as file, event_id % 1000 as e, user_id as uid, event_type, "
        "(select any_value(1)) as one, case when event_type = 'error' then 'stop' else 'ensure' end as command, case when event_id % 29 = 0 then '[g' || (user_id % 5) || ']' else 'u' || user_id end as target from events) select file, line", 1
    ).replace("(select any_value(1)) as one, ", ""),
)
def _(spark, sf):
    return CF.config_directives(config_texts(spark, sf)).select("file", "line", "kind", "command", "target", "is_category", "value")


def config_texts(spark, sf):
    """Events as configuration files of 1000 entries of four lines each."""
    e, u = F.col("event_id"), F.col("user_id")
    command = F.when(F.col("event_type") == "error", "stop").otherwise("Ensure")
    target = F.when(e % 29 == 0, F.concat(F.lit("[g"), V.S(u % 5), F.lit("]"))).otherwise(V.pre("u", u))
    text = F.concat(
        F.lit("  "), command, F.lit(" "), target, F.lit(" # started by hand\n"),
        F.lit("// ensure nothing\n"),
        F.lit("setr key_"), V.S(u), F.lit(' "'), F.col("event_type"), F.lit(' v" '), V.S(e % 1000), F.lit("\n"),
        F.lit("exec 'part "), V.S(u), F.lit(".cfg' // next"),
    )
    return (
        V.table(spark, sf, "events")
        .groupBy(V.pre("cfg", F.floor(e / 1000).cast("bigint")).alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct(e.alias("e"), text.alias("t")))).alias("parts"))
        .select(F.concat("n", F.lit(".cfg")).alias("file"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("text"))
    )


@query(
    "started_resources",
    """select server_id, target from (select server_id, target, arg_max(command, line) as command from v_directives where target not like '[%]' group by 1, 2)
    where command <> 'stop'""",
)
def _(spark, sf):
    return CF.started_resources(V.directives(spark, sf))


@query(
    "ensure_missing",
    f"""select {fnd("'CFG-ENSURE-MISSING-001'", "''", "'server.cfg'", "line", "target")} as id, 'CFG-ENSURE-MISSING-001' as rule_id, server_id, target, command, line,
    case when target in {BUNDLED} then 'INFO' else 'HIGH' end as severity, case when target in {BUNDLED} then 0.2::DOUBLE else 0.9::DOUBLE end as confidence
    from (select server_id, target, min(line) as line, arg_min(command, line) as command from v_directives where command <> 'stop' and target not like '[%]'
      and target not in (select 'u' || s_suppkey from supplier union all select 'u' || (110 + n_nationkey) from nation) group by 1, 2)""",
)
def _(spark, sf):
    res = V.table(spark, sf, "supplier").select(V.pre("u", "s_suppkey").alias("resource"))
    alias = V.table(spark, sf, "nation").select(V.pre("u", F.lit(110) + F.col("n_nationkey")).alias("alias"))
    return CF.ensure_missing(V.directives(spark, sf), res, alias)


def manifests(spark, sf):
    p = F.col("p_partkey")
    none = F.array().cast("array<string>")
    return V.table(spark, sf, "part").select(
        V.pre("n", p).alias("resource"),
        V.pick(p % 9, "none", "__resource", *["fxmanifest"] * 7).alias("kind"),
        (p % 25 != 3).alias("readable"),
        F.when(p % 21 == 5, F.array(p % 50, p % 50 + 1)).otherwise(F.array().cast("array<bigint>")).alias("syntax_lines"),
        V.pick(p % 5, None, "adamant", "cerulean", "future", "bodacious").alias("fx_version"),
        F.when(p % 8 == 0, none).when(p % 8 == 1, F.array(F.lit("gta5"), F.lit("pong"))).when(p % 8 == 2, F.array(F.lit("chess")))
        .otherwise(F.array(F.lit("gta5"))).alias("games"),
    )


@query(
    "manifest_checks",
    """with m as (select 'n' || p_partkey as resource, p_partkey as p, case p_partkey % 9 when 0 then 'none' when 1 then '__resource' else 'fxmanifest' end as kind,
      p_partkey % 25 <> 3 as readable, p_partkey % 21 = 5 as syn, (['', 'adamant', 'cerulean', 'future', 'bodacious'])[p_partkey % 5 + 1] as fx from part),
    g as (select * from m where kind <> 'none' and readable and not syn)
    select resource, 'CFG-MANIFEST-001' as rule_id, "check", severity, confidence::DOUBLE as confidence, detail from (
    select resource, 'no-manifest' as "check", 'HIGH' as severity, 0.85 as confidence, null as detail from m where kind = 'none'
    union all select resource, 'unreadable', 'MEDIUM', 0.9, null from m where kind <> 'none' and not readable
    union all select resource, 'syntax', 'HIGH', 0.95, (p % 50)::VARCHAR from m where kind <> 'none' and readable and syn
    union all select resource, 'syntax', 'HIGH', 0.95, (p % 50 + 1)::VARCHAR from m where kind <> 'none' and readable and syn
    union all select resource, 'missing-fx-version', 'MEDIUM', 0.9, null from g where kind = 'fxmanifest' and fx = ''
    union all select resource, 'unknown-fx-version', 'LOW', 0.5, fx from g where fx = 'future'
    union all select resource, 'missing-game', 'LOW', 0.8, null from g where kind = 'fxmanifest' and p % 8 = 0
    union all select resource, 'unknown-game', 'LOW', 0.5, 'pong' from g where p % 8 = 1
    union all select resource, 'unknown-game', 'LOW', 0.5, 'chess' from g where p % 8 = 2
    union all select resource, 'legacy-manifest', 'INFO', 0.95, null from g where kind = '__resource')""",
)
def _(spark, sf):
    return CF.manifest_checks(manifests(spark, sf))


def declared(spark, sf):
    """What manifests declare: per resource and language, four patterns."""
    per = V.table(spark, sf, "documents").select("source", "lang").distinct()
    pat = lambda s, *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    lang = F.col("lang")
    rows = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("line"), p.alias("pattern"), F.lit(side).alias("side"), ext.alias("external_resource"))
            for i, p, side, ext in (
                (1, pat(0, lang, "/*.lua"), "client", F.lit(None).cast("string")),
                (2, pat(0, "**/*1.lua"), "server", F.lit(None).cast("string")),
                (3, pat(0, "moved/", lang, "/?.*"), "client", F.lit(None).cast("string")),
                (4, pat(0, lang, "/readme.md"), "server", F.lit(None).cast("string")),
                (5, pat(0, lang, "/1??.js"), "client", F.lit(None).cast("string")),
                (6, pat(0, "lib/", lang, ".lua"), "client", F.lit("other")),
            )
        ]
    )
    return per.select(F.col("source").alias("resource"), F.explode(rows).alias("r")).select(
        "resource", F.lit("files").alias("directive"), "r.pattern", "r.line", "r.side", "r.external_resource"
    )


def owned_files(spark, sf):
    return V.files(spark, sf, "after").where(F.col("resource").isNotNull()).select("resource", F.col("name").alias("path"))


DECLARED = """(select source as resource, 'files' as directive, line::BIGINT as line, replace(pattern, 'LANG', lang) as pattern, rx, side from
  (select distinct source, lang from documents) cross join (values
  (1, 'LANG/*.lua', '^LANG/[^/]*\\.lua$', 'client'), (2, '**/*1.lua', '^([^/]*/)*[^/]*1\\.lua$', 'server'), (3, 'moved/LANG/?.*', '^moved/LANG/[^/]\\.[^/]*$', 'client'),
  (4, 'LANG/readme.md', '^LANG/readme\\.md$', 'server'), (5, 'LANG/1??.js', '^LANG/1[^/][^/]\\.js$', 'client')) t(line, pattern, rx0, side),
  lateral (select replace(rx0, 'LANG', lang) as rx))"""


@query(
    "missing_files",
    f"""select {fnd("'CFG-MISSING-FILE-001'", "resource", "'manifest'", "line", "directive || ':' || pattern")} as id, 'CFG-MISSING-FILE-001' as rule_id, resource, directive, pattern, line,
    case when pattern like '%*%' or pattern like '%?%' then 'MEDIUM' else 'HIGH' end as severity,
    case when pattern like '%*%' or pattern like '%?%' then 0.6::DOUBLE else 0.95::DOUBLE end as confidence
    from {DECLARED} d where not exists (select 1 from v_files_after f where f.resource = d.resource and regexp_matches(f.name, d.rx))""",
)
def _(spark, sf):
    return CF.missing_files(declared(spark, sf), owned_files(spark, sf)).select(
        "id", "rule_id", "resource", "directive", "pattern", "line", "severity", "confidence"
    )


@query(
    "script_sides",
    f"""select f.resource, f.name as path, case when count(d.side) = 0 then 'unknown' when count(distinct d.side) > 1 then 'shared' else any_value(d.side) end as side
    from (select * from v_files_after where resource is not null) f left join {DECLARED} d on d.resource = f.resource and regexp_matches(f.name, d.rx) group by 1, 2""",
)
def _(spark, sf):
    return CF.script_sides(declared(spark, sf), owned_files(spark, sf))


def _variables_sql() -> str:
    from .q_text import _redact_sql

    return f"""select file, line, target, case when value = '' then value
    when target = 'my_api_key' or {_redact_sql('value')} <> value or {_redact_sql("(target || ' = \"' || value || '\"')")} <> target || ' = "' || value || '"' then '(redacted)'
    when length(value) > 64 and strpos(value, ' ') = 0 then substr(value, 1, least(6, length(value) // 4)) || '********' else value end as value
    from (select 'server.cfg' as file, doc_id as line, (['sv_name', 'my_api_key', 'rcon'])[doc_id % 3 + 1] as target,
      case when doc_id % 2 = 0 then sha256(text) else text end as value from documents)"""


def redact_variables(spark, sf):
    docs = V.table(spark, sf, "documents")
    variables = docs.select(
        F.lit("server.cfg").alias("file"), F.col("doc_id").alias("line"),
        V.pick(F.col("doc_id") % 3, "sv_name", "my_api_key", "rcon").alias("target"),
        F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise(F.col("text")).alias("value"),
    )
    return CF.redact_variables(variables)
