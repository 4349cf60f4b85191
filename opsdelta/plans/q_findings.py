"""Finding, health and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence_band, finding_id, fixed, iso, normalize_confidence, r6
from ..operators import findings as FI
from ..operators import health as HE
from ..operators import retention as RT
from ..operators.tables import cascade, upsert
from . import views as V
from .registry import fnd, iso_sql, jsr, query, r6 as r6s

ORDER = "sev desc, confidence desc, rule_id, coalesce(resource, ''), coalesce(file, ''), coalesce(line, 0), id"
SHOW = ["id", "rule_id", "severity", "confidence", "resource", "file", "line"]


def show(df, *extra):
    return df.select(*SHOW, *extra)


@query("finding_ids", f"select key, {fnd('rule_id', 'resource', 'file', 'case when line % 4 <> 0 then line end', 'title')} as id from v_findings")
def _(spark, sf):
    line = F.when(F.col("line") % 4 != 0, F.col("line"))
    return V.findings(spark, sf).select("key", finding_id("rule_id", "resource", "file", line, "title").alias("id"))


@query(
    "confidence_bands",
    f"""select key, c as confidence, case when c >= 0.9 then 'VERY_HIGH' when c >= 0.75 then 'HIGH' when c >= 0.5 then 'MODERATE'
    when c >= 0.25 then 'LOW' else 'VERY_LOW' end as band from (select key, {jsr('least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence * 1.37::DOUBLE - 0.1::DOUBLE))', 2)} as c from v_findings)""",
)
def _(spark, sf):
    f = V.findings(spark, sf).select("key", normalize_confidence(F.col("confidence") * 1.37 - 0.1).alias("confidence"))
    return f.withColumn("band", confidence_band("confidence"))


@query(
    "max_severity",
    "select resource, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[max(sev) + 1] as max_severity from v_findings group by resource",
)
def _(spark, sf):
    return FI.max_severity(V.findings(spark, sf), ["resource"])


@query("top_findings", f"select {', '.join(SHOW)} from v_findings order by {ORDER} limit 50")
def _(spark, sf):
    return show(FI.top_findings(V.findings(spark, sf), 50))


SEVS = "(values ('INFO'), ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity)"


@query("severity_counts", f"select s.severity, count(f.id) as finding_count from {SEVS} left join v_findings f on f.severity = s.severity group by 1")
def _(spark, sf):
    return FI.count_by_severity(V.findings(spark, sf))


@query("finding_summary", "select category, rule_id, count(*) as finding_count from v_findings group by grouping sets ((category), (rule_id))")
def _(spark, sf):
    return FI.finding_summary(V.findings(spark, sf))


@query(
    "filter_findings",
    f"select {', '.join(SHOW)} from v_findings where sev >= 2 and category = 'SECURITY' and rule_id <> 'CFG-MANIFEST-001'",
)
def _(spark, sf):
    return show(FI.filter_findings(V.findings(spark, sf), "MEDIUM", "security", disabled=["CFG-MANIFEST-001"]))


@query(
    "truncated_findings",
    f"""select {', '.join(SHOW)}, (select count(*) from v_findings) as total, (select (count(*) - 100) || ' more findings match and are left out here.' from v_findings) as note
    from v_findings order by {ORDER} limit 100""",
)
def _(spark, sf):
    return show(FI.truncated(V.findings(spark, sf), 100), "total", "note")


@query(
    "findings_by_resource",
    f"select resource, row_number() over (partition by resource order by {ORDER}) as position, id from v_findings where resource is not null",
)
def _(spark, sf):
    return FI.findings_by_resource(V.findings(spark, sf))


@query("fail_gate", "select coalesce(bool_or(sev >= 4), false) as failed from v_findings")
def _(spark, sf):
    return FI.fail_gate(V.findings(spark, sf), "CRITICAL")


def _runs(spark, sf):
    """What an earlier and a later run found; ids say what, not when."""
    f = V.findings(spark, sf).withColumn("id", finding_id("rule_id", "resource", "file", F.lit(None).cast("string"), "title"))
    late = F.col("created_at") >= F.lit(V.SPLIT).cast("timestamp")
    newest = lambda df: df.groupBy("id").agg(
        *[F.max_by(c, "key").alias(c) for c in ("rule_id", "run_id", "severity", "confidence", "title", "evidence_count", "created_at")]
    )
    return newest(f.where(~late)), newest(f.where(late))


RUN = f"""(select {fnd('rule_id', 'resource', 'file', 'null', 'title')} as id, arg_max(rule_id, key) as rule_id, arg_max(run_id, key) as run_id,
  arg_max(severity, key) as severity, arg_max(confidence, key) as confidence, arg_max(title, key) as title, arg_max(evidence_count, key) as evidence_count,
  arg_max(created_at, key) as created_at from v_findings where (created_at >= timestamp '{V.SPLIT}') = %s group by 1)"""


@query(
    "upsert_findings",
    f"""select coalesce(a.id, b.id) as id, coalesce(b.rule_id, a.rule_id) as rule_id, coalesce(a.run_id, b.run_id) as run_id,
    coalesce(a.severity, b.severity) as severity, {r6s('coalesce(a.confidence, b.confidence)')} as confidence, coalesce(b.title, a.title) as title,
    coalesce(a.evidence_count, b.evidence_count) as evidence_count, {iso_sql('coalesce(a.created_at, b.created_at)')} as created_at
    from {RUN % 'false'} b full outer join {RUN % 'true'} a on a.id = b.id""",
)
def _(spark, sf):
    old, new = _runs(spark, sf)
    out = upsert(old, new, ["id"], update=["run_id", "severity", "confidence", "evidence_count", "created_at"])
    return out.withColumn("confidence", r6("confidence")).withColumn("created_at", iso("created_at"))


@query(
    "validate_findings",
    """select id, 'recommendation' as path, 'no recommendation' as message from v_findings where trim(recommendation) = ''
    union all select id, 'evidence', 'no evidence above INFO' from v_findings where sev > 0 and evidence_count = 0""",
)
def _(spark, sf):
    return FI.validate_findings(V.findings(spark, sf))


@query(
    "catalog_join",
    """select f.rule_id, c.catalog_category, c.default_severity, c.rule_id is not null as accepted, count(*) as finding_count
    from v_findings f left join v_catalog c using (rule_id) group by 1, 2, 3, 4""",
)
def _(spark, sf):
    j = FI.catalog_join(V.findings(spark, sf))
    return j.groupBy("rule_id", "catalog_category", "default_severity", "accepted").agg(F.count(F.lit(1)).alias("finding_count"))


@query(
    "recent_runs",
    f"""select run_id, {iso_sql('max(created_at)')} as finished_at, count(*) as finding_count from v_findings group by run_id order by max(created_at) desc, run_id limit 5""",
)
def _(spark, sf):
    runs = V.findings(spark, sf).groupBy("run_id").agg(F.max("created_at").alias("finished_at"), F.count(F.lit(1)).alias("finding_count"))
    return runs.orderBy(F.col("finished_at").desc(), "run_id").limit(5).withColumn("finished_at", iso("finished_at"))


@query(
    "security_section",
    f"select s.severity, count(f.id) as finding_count from {SEVS} left join v_findings f on f.severity = s.severity and f.category = 'SECURITY' group by 1",
)
def _(spark, sf):
    return FI.security_section(V.findings(spark, sf))


# ------------------------------------------------------------------- health

AVAILABLE = ["PERFORMANCE", "SECURITY", "DEPENDENCIES", "CONFIGURATION"]
AV = "('PERFORMANCE', 'SECURITY', 'DEPENDENCIES', 'CONFIGURATION')"


@query("health_deductions", "select id, health_category, rule_id, severity, points from v_deductions")
def _(spark, sf):
    return HE.deductions(V.findings(spark, sf)).select("id", "health_category", "rule_id", "severity", "points")


CLAMPED = "least(100, greatest(0, floor(({}) + 0.5)))::BIGINT"
CATS = f"""(select w.health_category, w.weight, coalesce(sum(d.points), 0)::BIGINT as points, {CLAMPED.format('100 - coalesce(sum(d.points), 0)')} as score
  from v_weights w left join v_deductions d using (health_category) where w.health_category in {AV} group by 1, 2)"""


@query("category_scores", f"select health_category, weight, points, score from {CATS}")
def _(spark, sf):
    return HE.category_scores(V.findings(spark, sf), AVAILABLE)


CAP = f"""(select * from (select severity as cap_severity, rule_id as cap_rule_id, id as cap_finding_id, title as cap_title,
  case severity when 'CRITICAL' then 40 else 75 end as cap, resource from v_findings
  where (severity = 'CRITICAL' and confidence >= 0.5) or (severity = 'HIGH' and confidence >= 0.75) order by {ORDER} limit 1))"""


@query(
    "health_score",
    f"""select least(u, coalesce(cap, 100))::BIGINT as score, u as uncapped_score, points, cap::BIGINT as cap, cap_rule_id from
    (select {CLAMPED.format('sum(weight * score) / sum(weight)')} as u, sum(points)::BIGINT as points from {CATS}) left join {CAP} on true""",
)
def _(spark, sf):
    return HE.health_score(V.findings(spark, sf), AVAILABLE)


RCAP = f"""(select * from (select resource, case severity when 'CRITICAL' then 40 else 75 end as cap, severity as cap_severity, rule_id as cap_rule_id,
  id as cap_finding_id, title as cap_title, row_number() over (partition by resource order by {ORDER}) as rn
  from v_findings where (severity = 'CRITICAL' and confidence >= 0.5) or (severity = 'HIGH' and confidence >= 0.75)) where rn = 1)"""


@query("health_caps", f"select resource, cap::BIGINT as cap, cap_severity, cap_rule_id, cap_finding_id, cap_title from {RCAP} where resource is not null")
def _(spark, sf):
    return HE.caps(V.findings(spark, sf).where(F.col("resource").isNotNull()), ["resource"])


@query(
    "primary_reasons",
    f"""select 0::BIGINT as position, 'capped at ' || cap || ' by ' || cap_severity || ' ' || cap_rule_id || ': ' || cap_title as reason from {CAP}
    union all select r, severity || ': ' || n || ' ' || rule_id || case when n = 1 then ' finding (-' else ' findings (-' end || pts || ')' from (
      select *, row_number() over (order by pts desc, severity, rule_id) as r from (select severity, rule_id, count(*) as n, sum(points) as pts
      from v_deductions where health_category in {AV} group by 1, 2)) where r <= 5""",
)
def _(spark, sf):
    return HE.primary_reasons(V.findings(spark, sf), AVAILABLE)


def customers(spark, sf):
    return V.table(spark, sf, "customer").select(V.pre("c", "c_custkey").alias("resource"))


PER = f"""(select c.resource, g.category as health_category, w.weight, {CLAMPED.format('100 - coalesce(d.points, 0)')} as score, coalesce(d.points, 0)::BIGINT as points
  from (select 'c' || c_custkey as resource from customer) c cross join (select unnest(['PERFORMANCE', 'SECURITY', 'DEPENDENCIES', 'CONFIGURATION']) as category) g
  join v_weights w on w.health_category = g.category
  left join (select resource, health_category, sum(points) as points from v_deductions group by 1, 2) d on d.resource = c.resource and d.health_category = g.category)"""
HEALTH = f"""(select p.resource, least(p.u, coalesce(k.cap, 100))::BIGINT as score, p.u as uncapped_score, p.points, k.cap::BIGINT as cap, k.cap_rule_id from
  (select resource, {CLAMPED.format('sum(weight * score) / sum(weight)')} as u, sum(points)::BIGINT as points from {PER} group by resource) p left join {RCAP} k using (resource))"""


def resource_health(spark, sf):
    return HE.health_score(V.findings(spark, sf), AVAILABLE, ["resource"], customers(spark, sf))


@query("resource_health", f"select * from {HEALTH}")
def _(spark, sf):
    return resource_health(spark, sf)


@query(
    "resource_reasons",
    f"""with top as (select resource, r as position, severity || ': ' || n || ' ' || rule_id || case when n = 1 then ' finding (-' else ' findings (-' end || pts || ')' as reason from (
      select *, row_number() over (partition by resource order by pts desc, severity, rule_id) as r from (select resource, severity, rule_id, count(*) as n, sum(points) as pts
      from v_deductions where health_category in {AV} and resource is not null group by 1, 2, 3)) where r <= 5
    union all select resource, 0, 'capped at ' || cap || ' by ' || cap_severity || ' ' || cap_rule_id || ': ' || cap_title from {RCAP} where resource is not null)
    select * from top union all select 'c' || c_custkey, 1, 'Nothing was deducted: the score is full.' from customer where 'c' || c_custkey not in (select resource from top)""",
)
def _(spark, sf):
    f = V.findings(spark, sf).where(F.col("resource").isNotNull())
    return HE.primary_reasons(f, AVAILABLE, ["resource"], customers(spark, sf))


@query("worst_resources", f"select resource, score from {HEALTH} order by score, resource limit 10")
def _(spark, sf):
    return HE.worst_resources(resource_health(spark, sf)).select("resource", "score")


@query(
    "unavailable_categories",
    f"""select w.health_category, case w.health_category when 'RELIABILITY' then 'no source for errors' else 'not analysed' end as reason,
    count(f.id) as unscored_findings from v_weights w
    left join v_findings f on w.health_category = case f.category when 'ERRORS' then 'RELIABILITY' else f.category end
    where w.health_category not in {AV} group by 1, 2""",
)
def _(spark, sf):
    u = HE.unavailable(spark, AVAILABLE, {"RELIABILITY": "no source for errors"})
    n = V.findings(spark, sf).groupBy(HE.health_category().alias("health_category")).agg(F.count(F.lit(1)).alias("n"))
    return u.join(n, "health_category", "left").select("health_category", "reason", F.coalesce("n", F.lit(0)).alias("unscored_findings"))


@query(
    "resources_overview",
    f"""select c.resource, c.version, c.file_count, coalesce(d.n, 0) as dependency_count, coalesce(f.n, 0) as finding_count, h.score as health_score
    from (select 'c' || c_custkey as resource, 'v' || c_nationkey as version, c_nationkey::BIGINT as file_count from customer) c
    left join (select 'c' || substr("from", 2) as resource, count(*) as n from v_edges where kind = 'DECLARED' group by 1) d using (resource)
    left join (select resource, count(*) as n from v_findings group by 1) f using (resource) left join {HEALTH} h using (resource)""",
)
def _(spark, sf):
    from ..operators import graph as GR

    res = V.table(spark, sf, "customer").select(
        V.pre("c", "c_custkey").alias("resource"), V.pre("v", "c_nationkey").alias("version"), F.col("c_nationkey").cast("bigint").alias("file_count")
    )
    edges = GR.build_edges(V.dependencies(spark, sf), V.references(spark, sf)).where(F.col("kind") == "DECLARED")
    deps = edges.select(F.concat(F.lit("c"), F.substr("from", F.lit(2))).alias("resource"))
    return FI.resources_overview(res, deps, V.findings(spark, sf), resource_health(spark, sf))


# ---------------------------------------------------------------- retention

NOW = "2000-01-01T00:00:00"


def tables(spark, sf):
    d = fixed.RETENTION_DAYS
    return {
        "performance_samples": (V.samples(spark, sf), "sampled_at", d["performance_samples"]),
        "scan_runs": (V.findings(spark, sf), "created_at", d["scan_runs"]),
        "incidents": (V.baselines(spark, sf), "created_at", d["incidents"]),
        "integrity_snapshots": (V.files(spark, sf, "after"), "modified_at", 0),
    }


@query(
    "purge_server",
    "select 'performance_samples' as table_name, count(*) filter (server_id = (select min(server_id) from v_samples)) as deleted, "
    "count(*) filter (server_id <> (select min(server_id) from v_samples)) as kept from v_samples",
)
def _(spark, sf):
    """Everything of one server goes, whatever its age."""
    samples = V.samples(spark, sf)
    first = samples.agg(F.min("server_id").alias("s")).first()["s"]  # one value
    return RT.purge_counts({"performance_samples": (samples, "sampled_at", 30)}, F.lit(NOW).cast("timestamp"), first, everything=True)


@query(
    "retention_dry_run",
    "\nunion all ".join(
        f"select '{n}' as table_name, count(*) filter ({cond}) as deleted, count(*) filter (not ({cond})) as kept from {v}"
        for n, v, cond in (
            ("performance_samples", "v_samples", "sampled_at < timestamp '2000-01-01' - interval 30 day"),
            ("scan_runs", "v_findings", "created_at < timestamp '2000-01-01' - interval 90 day"),
            ("incidents", "v_baselines", "created_at < timestamp '2000-01-01' - interval 180 day"),
            ("integrity_snapshots", "v_files_after", "false"),
        )
    ),
)
def _(spark, sf):
    return RT.purge_counts(tables(spark, sf), F.lit(NOW).cast("timestamp"))


@query("purge", "select key, rule_id from v_findings where created_at >= timestamp '2000-01-01' - interval 90 day")
def _(spark, sf):
    kept = RT.purge(V.findings(spark, sf), "created_at", F.lit(NOW).cast("timestamp"), 90)
    return kept.select("key", "rule_id")


@query(
    "cascade_delete",
    """select l_orderkey as order_key, count(*) as item_count from lineitem where l_orderkey not in
    (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)) group by 1""",
)
def _(spark, sf):
    gone = V.table(spark, sf, "customer").where(F.col("c_acctbal") < 0)
    orders, items = V.table(spark, sf, "orders"), V.table(spark, sf, "lineitem")
    lost = orders.join(gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    left = cascade(items, lost, "l_orderkey", "o_orderkey")
    return left.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count(F.lit(1)).alias("item_count"))


@query(
    "storage_usage",
    "\nunion all ".join(
        f"select '{n}' as table_name, count(*) as row_count from {v}{w}"
        for n, v, w in (
            ("samples", "v_samples", " where server_id = 'srv1'"), ("findings", "v_findings", " where server_id = 'srv1'"),
            ("baselines", "v_baselines", " where server_id = 'srv1'"), ("nodes", "part", ""),
        )
    ),
)
def _(spark, sf):
    return RT.storage_usage(
        {"samples": V.samples(spark, sf), "findings": V.findings(spark, sf), "baselines": V.baselines(spark, sf), "nodes": V.nodes(spark, sf)}, "srv1"
    )
