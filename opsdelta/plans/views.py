"""The given tables seen as operations data, once in Spark and once in SQL.

Every view covers its whole table. Both forms use the same arithmetic; the SQL
form is what the oracles read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sha_id
from ..session import spread

SPLIT = "1998-06-01"


HEAVY = ["documents", "pages"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; those with costly work per row are spread over the cores."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def S(x) -> Column:
    """A column as text."""
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def pre(prefix: str, x) -> Column:
    return F.concat(F.lit(prefix), S(x))


def pick(index: Column, *names: str | None) -> Column:
    """The name at a 0-based index."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def k_of_props() -> Column:
    return F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))


SIGNAL_KINDS = {
    "click": "RESOURCE_CHANGED",
    "signup": "RESOURCE_ADDED",
    "view": "CONFIG_CHANGED",
    "error": "ERROR_SPIKE",
    "purchase": "PERFORMANCE_REGRESSION",
}


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return as_signals(table(spark, sf, "events"))


def as_signals(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNAL_KINDS.items() for x in kv]), F.col("event_type"))
    resource = F.when(F.col("event_type") != "view", pre("r", k_of_props() % 5))
    return events.select(
        F.col("event_id").alias("id"),
        pre("srv", "user_id").alias("server_id"),
        kind.alias("kind"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        resource.alias("resource"),
        F.concat("event_type", F.lit(" on "), F.coalesce(resource, F.lit("SERVER"))).alias("description"),
        F.when(F.col("event_type") == "error", sha_id("fnd_", pre("ord ", F.col("event_id") * 3))).alias("finding_id"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    k, q = F.col("l_suppkey"), F.col("l_quantity")
    at = F.col("l_shipdate").cast("timestamp")
    after = at >= F.lit(SPLIT).cast("timestamp")
    value = (
        F.when(k % 7 == 4, q * q / 50)
        .when(after & (k % 7 == 5), q * F.lit(0.3))
        .when(after & (k % 5 == 0), q * 2)
        .otherwise(q)
    )
    rare = (k % 7 == 3) & ~after & (F.col("l_orderkey") % 40 != 0)
    return table(spark, sf, "lineitem").select(
        pre("srv", k % 4).alias("server_id"),
        pre("s", k).alias("resource"),
        F.when(rare, "qty_rest").otherwise("qty").alias("metric"),
        value.alias("value"),
        F.lit("units").alias("unit"),
        F.col("l_linenumber").cast("bigint").alias("player_count"),
        at.alias("sampled_at"),
        (at + F.make_dt_interval(days=F.col("l_linenumber"))).alias("imported_at"),
        F.lit("collector@1").alias("source"),
        F.when(after, "after").otherwise("before").alias("side"),
    )


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select((F.col("l_suppkey") % 4).alias("s"), F.year("l_shipdate").alias("y"))
        .distinct()
        .select(
            pre("srv", "s").alias("server_id"),
            pre("b", "y").alias("label"),
            F.make_timestamp(F.col("y"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"),
        )
    )


def files(spark: SparkSession, sf: str, when: str) -> DataFrame:
    """Documents as files; 'after' renames some, edits some and touches some."""
    d = F.col("doc_id")
    later = F.lit(when == "after")
    ext = (
        F.when(d % 31 == 0, "sh").when(d % 29 == 0, "db").when(d % 23 == 0, "dll").when(d % 19 == 0, "zip")
        .when(d % 17 == 0, "exe").when(F.col("lang") == "en", "lua").when(F.col("lang") == "fr", "js")
        .when(F.col("lang") == "de", "json").otherwise("cfg")
    )
    moved = later & (d % 10 == 1)
    edited = later & (d % 7 == 0)
    name = F.concat(F.when(moved, F.lit("moved/")).otherwise(F.lit("")), "lang", F.lit("/"), S(d), F.lit("."), ext)
    resource = F.when(d % 13 != 0, F.col("source"))
    base = F.timestamp_seconds(F.lit(1704067200) + d)
    return table(spark, sf, "documents").select(
        pre("srv", d % 4).alias("server_id"),
        F.concat(F.coalesce(resource, F.lit("root")), F.lit("/"), name).alias("path"),
        name.alias("name"),
        resource.alias("resource"),
        (F.col("n_chars") + F.when(edited, 1).otherwise(0)).alias("size_bytes"),
        F.sha2(F.when(edited, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"),
        F.when(later & (d % 11 == 0), base + F.expr("interval 1 day")).otherwise(base).alias("modified_at"),
    )


CATEGORIES = ["CONFIGURATION", "DEPENDENCIES", "PERFORMANCE", "SECURITY", "INTEGRITY", "ERRORS"]
VIEW_RULES = ["CFG-MANIFEST-001", "DEP-MISSING-001", "PERF-LOOP-001", "SEC-SECRET-001", "INT-CHANGE-001", "ERR-OTHER-001"]


def findings(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    severity = (
        F.when(F.col("o_orderpriority").startswith("1"), "CRITICAL").when(F.col("o_orderpriority").startswith("2"), "HIGH")
        .when(F.col("o_orderpriority").startswith("3"), "MEDIUM").when(F.col("o_orderpriority").startswith("4"), "LOW")
        .otherwise("INFO")
    )
    return table(spark, sf, "orders").select(
        sha_id("fnd_", pre("ord ", o)).alias("id"),
        o.alias("key"),
        pre("srv", F.col("o_custkey") % 4).alias("server_id"),
        pre("run", F.year("o_orderdate")).alias("run_id"),
        pick(o % 6, *VIEW_RULES).alias("rule_id"),
        pick(o % 6, *CATEGORIES).alias("category"),
        severity.alias("severity"),
        ((o % 101) / F.lit(100.0)).alias("confidence"),
        pre("title ", o % 10).alias("title"),
        F.when(o % 90 != 7, F.lit("look into it")).otherwise(F.lit(" ")).alias("recommendation"),
        F.when(o % 50 != 0, pre("c", "o_custkey")).alias("resource"),
        F.concat(F.lit("f"), S(o % 7), F.lit(".lua")).alias("file"),
        (o % 200).alias("line"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (o % 3).alias("evidence_count"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(pre("n", "p_partkey").alias("name"), F.col("p_partkey").alias("ord"))


def _target() -> Column:
    p = F.col("p_partkey")
    block = F.floor(p / 6).cast("bigint")
    step = (p % 6 + 1 + block % 3) % 6
    return (
        F.when((p % 11 == 0) & (p % 2 == 0), pre("alias", F.floor(p / 11).cast("bigint")))
        .when((p % 11 == 0) & (p % 3 == 0), F.lit("mapmanager"))
        .when(p % 11 == 0, pre("missing", p))
        .otherwise(pre("n", p - p % 6 + step))
    )


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Declared dependencies: every part twice (repeats fold), and a constraint."""
    p = F.col("p_partkey")
    part = table(spark, sf, "part")
    main = part.select(pre("n", p).alias("from"), _target().alias("to"), F.explode(F.array(p % 50, p % 50 + 10)).alias("line"))
    limits = part.select(pre("n", p).alias("from"), pre("/server:", p % 5).alias("to"), (p % 50).alias("line"))
    return main.unionByName(limits)


def references(spark: SparkSession, sf: str) -> DataFrame:
    """File references of every part: to its target's successor and to itself."""
    p = F.col("p_partkey")
    part = table(spark, sf, "part")
    main = part.select(pre("n", p).alias("from"), pre("n", p - p % 6 + (p + 1) % 6).alias("to"), (p % 50).alias("line"))
    selfref = part.select(pre("n", p).alias("from"), pre("n", p).alias("to"), F.lit(1).cast("bigint").alias("line"))
    return main.unionByName(selfref)


def provides(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        pre("n", p).alias("resource"), pre("alias", F.floor(p / 4).cast("bigint")).alias("alias"), p.alias("ord")
    )


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = k_of_props()
    e = F.col("event_id")
    direction = F.when(F.col("event_type") == "signup", "to-server").when(F.col("event_type") == "view", "to-client").otherwise("local")
    return table(spark, sf, "events").select(
        e.alias("id"),
        pre("u", "user_id").alias("resource"),
        F.concat(F.lit("f"), S(e % 9), F.lit(".lua")).alias("file"),
        (e % 500).alias("line"),
        F.when(e % 2 == 0, "server").otherwise("client").alias("side"),
        F.when(k % 3 == 0, "REGISTRATION").otherwise("TRIGGER").alias("kind"),
        F.col("event_type").alias("call"),
        F.when(k % 17 != 0, pre("e", k % 40)).alias("event"),
        direction.alias("direction"),
        ((F.col("event_type") == "view") & (e % 2 == 0)).alias("broadcast"),
        (e % 700).alias("loop_line"),
    )


def directives(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    target = F.when(u % 37 == 1, "mapmanager").when(e % 29 == 0, F.concat(F.lit("[g"), S(u % 5), F.lit("]"))).otherwise(pre("u", u))
    return table(spark, sf, "events").select(
        pre("srv", u % 4).alias("server_id"),
        target.alias("target"),
        e.alias("line"),
        F.when(F.col("event_type") == "error", "stop").otherwise("ensure").alias("command"),
    )


def loops(spark: SparkSession, sf: str) -> DataFrame:
    """Loop facts of every order; several loops may share a file and a line."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        o.alias("id"),
        pre("c", c).alias("resource"),
        F.concat(F.lit("f"), S(c % 9), F.lit(".lua")).alias("file"),
        o.alias("line"),
        pick(o % 3, "WHILE", "FOR", "REPEAT").alias("kind"),
        (o % 2 == 0).alias("continuous"),
        (o % 3 == 0).alias("yields"),
        F.when(o % 4 != 1, o % 120).alias("wait_ms"),
        (o % 4).alias("opaque_calls"),
        (c % 2 == 0).alias("inside_thread"),
        (c % 10 == 0).alias("unbalanced"),
        F.when(o % 5 != 0, pick(o % 3, "FOR", "WHILE", "REPEAT")).alias("loop_kind"),
        pick(o % 4, "MySQL.query", "oxmysql.fetch", "print", "exports.oxmysql:execute").alias("call"),
        pick(
            F.floor(F.col("o_totalprice")).cast("bigint") % 6,
            "SELECT * FROM t", "select a from t where b = 1", "SELECT * FROM t LIMIT 5", "UPDATE t SET a = 1",
            "select a from t", None,
        ).alias("sql"),
    )


CALL_NAMES = ["PerformHttpRequest", "load", "require", "print", "SaveResourceFile", "loadstring", "http.request", "warn", "io.open", "emit", "log"]


def scripts(spark, sf):
    """Script text made of each document, with nested, sugared, commented and unclosed calls; and the pages as they are."""
    d = table(spark, sf, "documents").where("doc_id is not null and source is not null")
    i = F.col("doc_id")
    target = F.element_at(F.array(*[F.lit(x) for x in ("helper.exe", "config.json", "bin/run.SH")]), (i % 3 + 1).cast("int"))
    text = F.concat(
        F.coalesce("text", F.lit("")), F.lit('\nPerformHttpRequest("http://'), "source", F.lit("/"), i.cast("string"), F.lit('", function(code, body)'),
        F.repeat(F.lit("\n"), (i % 80).cast("int")), F.lit('run(load(decode(body, -1), {1, "x"}, 0x1F)()) end)\nSaveResourceFile(self:name (), \''), target,
        F.lit("', data[1], -1)\nrequire \"m"), (i % 5).cast("string"), F.lit('" -- load(dead)\nprint{text} a().load(x) load("k", -2.5)('),
    )
    return d.select(pre("d", "doc_id").alias("file"), text.alias("text")).unionByName(table(spark, sf, "pages").select(pre("p", "page_id").alias("file"), F.col("html").alias("text")))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """A call on every line of every document, chosen from the line's place."""
    line = F.col("pos").cast("bigint") + 1
    n = F.col("doc_id") * 31 + line * 7
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
        .select(
            pre("d", "doc_id").alias("file"),
            line.alias("line"),
            pick(n % 11, *CALL_NAMES).alias("name"),
            F.when(n % 3 != 0, F.array(pick(n % 5, "a.exe", "data", "b.lua", "run.sh", "x.DLL")))
            .otherwise(F.array().cast("array<string>")).alias("string_args"),
            (n % 2 == 0).alias("has_non_literal"),
        )
    )


DOC_EVENTS = 5000


def _quoted(name: str, x: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"'), x, F.lit('"'))


def _plain(name: str, x) -> Column:
    return F.concat(F.lit(f'"{name}":'), S(x))


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def json_sample() -> Column:
    """An event as a JSON sample; every ninth has its number in quotes."""
    e = F.col("event_id")
    value = F.when(e % 9 == 0, _quoted("value", S("value"))).otherwise(_plain("value", "value"))
    return _object(
        _quoted("metric", F.col("event_type")), value, _quoted("unit", F.lit("ms")),
        F.when(e % 4 != 0, _plain("playerCount", k_of_props())), _plain("at", json_seconds()),
    )


def json_event() -> Column:
    """An event as a JSON event; every eleventh lacks its kind."""
    k = k_of_props()
    return _object(
        F.when(F.col("event_id") % 11 != 0, _quoted("kind", F.col("event_type"))),
        F.when(F.col("event_type") != "view", _quoted("resource", pre("r", k % 5))),
        _quoted("detail", pre("k=", k)), _plain("at", json_seconds()),
    )


def json_seconds() -> Column:
    return S((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("decimal(20,6)"))


def day_number() -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("bigint")


def json_document(samples: Column, events: Column) -> Column:
    """A telemetry document of one user and day; some users write broken ones."""
    u = F.col("user_id")
    dropped = F.concat(F.lit('"dropped":{"samples":'), S(u % 3), F.lit(',"events":'), S(u % 2), F.lit("}"))
    body = _object(
        F.when(u % 7 != 1, _quoted("schemaVersion", F.when(u % 7 == 0, "2.0").otherwise("1.0"))),
        _quoted("collector", F.lit("probe")),
        F.when(u % 4 != 0, _quoted("collectorVersion", pre("1.", u % 3))),
        _plain("writtenAt", F.when(F.col("day") % 5 == 0, F.lit(0)).otherwise(F.col("day") * 86400 + 86399)),
        _plain("serverUptimeMs", u * 1000),
        F.concat(F.lit('"samples":['), samples, F.lit("]")),
        F.concat(F.lit('"events":['), events, F.lit("]")),
        F.when(u % 5 != 0, dropped),
    )
    return (
        F.when(u % 7 == 2, F.concat(F.lit("["), body, F.lit("]"))).when(u % 7 == 3, F.concat(F.lit("{"), body)).otherwise(body)
    )


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as telemetry files: (file, server_id, json), some of them broken.

    A file covers one user, one day and at most 5000 consecutive events, the
    size of a writer's buffer.
    """
    docs = (
        table(spark, sf, "events")
        .select(
            "user_id", day_number().alias("day"), F.floor(F.col("event_id") / DOC_EVENTS).cast("bigint").alias("block"),
            json_sample().alias("s"), json_event().alias("v"),
        )
        .groupBy("user_id", "day", "block")
        .agg(F.collect_list("s").alias("s"), F.collect_list("v").alias("v"))
    )
    file = F.concat(F.lit("telemetry-"), S("user_id"), F.lit("-"), S("day"), F.lit("-"), S("block"), F.lit(".json"))
    return docs.select(
        file.alias("file"),
        pre("srv", F.col("user_id") % 4).alias("server_id"),
        json_document(F.array_join("s", ","), F.array_join("v", ",")).alias("json"),
    )


def buffer_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a few full telemetry files, 5000 samples and events in each."""
    blocks = (
        table(spark, sf, "events")
        .select(F.floor(F.col("event_id") / DOC_EVENTS).cast("bigint").alias("block"), json_sample().alias("s"), json_event().alias("v"))
        .groupBy("block")
        .agg(F.collect_list("s").alias("s"), F.collect_list("v").alias("v"))
        .withColumn("user_id", F.lit(4))
        .withColumn("day", F.col("block"))
    )
    return blocks.select(
        pre("telemetry-", "block").alias("file"), F.lit("srv0").alias("server_id"),
        json_document(F.array_join("s", ","), F.array_join("v", ",")).alias("json"),
    )


def event_documents(events: DataFrame) -> DataFrame:
    """Each event as a document of its own, delivered under two file names."""
    return events.withColumn("day", day_number()).select(
        F.explode(F.array(pre("a", "event_id"), pre("b", "event_id"))).alias("file"),
        pre("srv", F.col("user_id") % 4).alias("server_id"),
        json_document(json_sample(), json_event()).alias("json"),
    )


# ---------------------------------------------------------------- SQL twins

VIEWS = {
    "v_doc_rows": f"""
select *, 'telemetry-' || user_id || '-' || day || '-' || block || '.json' as file, 'srv' || (user_id % 4) as server_id,
       coalesce(json_extract_string(props, '$.k')::BIGINT, 0) as k, (epoch_us(ts) / 1000000.0::DOUBLE)::DOUBLE as at_s
from (select *, epoch_us(ts) // 86400000000 as day, event_id // {DOC_EVENTS} as block from events)""",
    "v_docs": """
select file, any_value(server_id) as server_id, any_value(user_id) as u, any_value(day) as day, count(*) as n,
       count(*) filter (event_id % 9 <> 0) as sample_count, count(*) filter (event_id % 11 <> 0) as event_count,
       case when any_value(user_id) % 5 <> 0 then any_value(user_id) % 3 else 0 end as dropped_samples,
       case when any_value(user_id) % 5 <> 0 then any_value(user_id) % 2 else 0 end as dropped_events,
       case when any_value(day) % 5 = 0 then 0 else any_value(day) * 86400 + 86399 end as written,
       case when any_value(user_id) % 4 <> 0 then '1.' || (any_value(user_id) % 3) end as collector_version,
       case any_value(user_id) % 7 when 0 then 'unsupported schemaVersion 2.0' when 1 then 'no schemaVersion'
            when 2 then 'not a JSON object' when 3 then 'not valid JSON' end as reason
from v_doc_rows group by file""",
    "v_doc_samples": """
select file, server_id, event_type as metric, value, 'ms' as unit, case when event_id % 4 <> 0 then k end as player_count, at_s, ts,
       'probe@' || coalesce(case when user_id % 4 <> 0 then '1.' || (user_id % 3) end, 'unknown') as source
from v_doc_rows where user_id % 7 > 3 and event_id % 9 <> 0""",
    "v_doc_events": """
select file, server_id, event_type as kind, case when event_type <> 'view' then 'r' || (k % 5) end as resource,
       'k=' || k as detail, at_s, ts,
       'probe@' || coalesce(case when user_id % 4 <> 0 then '1.' || (user_id % 3) end, 'unknown') as source
from v_doc_rows where user_id % 7 > 3 and event_id % 11 <> 0""",
    "v_doc_parts": """
select file, 'collector:probe' as part from v_docs where reason is null
union all select file, 'version:' || coalesce(collector_version, '') from v_docs where reason is null
union all select file, 'schema:1.0' from v_docs where reason is null
union all select file, 'written:' || cast(written as DECIMAL(38,6)) from v_docs where reason is null
union all select file, 'uptime:' || cast(u * 1000 as DECIMAL(38,6)) from v_docs where reason is null
union all select file, 's:' || metric || ':' || cast(value as DECIMAL(38,6)) || ':' || unit || ':' || cast(at_s as DECIMAL(38,6)) || ':'
       || coalesce(cast(cast(player_count as DECIMAL(38,6)) as VARCHAR), '') from v_doc_samples
union all select file, 'e:' || kind || ':' || coalesce(resource, '') || ':' || detail || ':' || cast(at_s as DECIMAL(38,6)) from v_doc_events""",
    "v_digests": """
select d.*, p.digest from v_docs d join (select file, sha256(string_agg(part, ' ' order by part) || ' ') as digest from v_doc_parts group by file) p
using (file)""",
    "v_signals": """
select event_id as id, 'srv' || user_id as server_id,
       case event_type when 'click' then 'RESOURCE_CHANGED' when 'signup' then 'RESOURCE_ADDED'
            when 'view' then 'CONFIG_CHANGED' when 'error' then 'ERROR_SPIKE'
            when 'purchase' then 'PERFORMANCE_REGRESSION' end as kind,
       ts as occurred_at,
       case when event_type <> 'view' then 'r' || (coalesce(json_extract_string(props, '$.k')::BIGINT, 0) % 5) end as resource,
       event_type || ' on ' || coalesce(case when event_type <> 'view' then 'r' ||
            (coalesce(json_extract_string(props, '$.k')::BIGINT, 0) % 5) end, 'SERVER') as description,
       case when event_type = 'error' then 'fnd_' || substr(sha256('ord ' || (event_id * 3)), 1, 16) end as finding_id,
       epoch_us(ts) // 1000 as ms
from events""",
    "v_samples": f"""
select 'srv' || (l_suppkey % 4) as server_id, 's' || l_suppkey as resource,
       case when l_suppkey % 7 = 3 and l_shipdate < timestamp '{SPLIT}' and l_orderkey % 40 <> 0
            then 'qty_rest' else 'qty' end as metric,
       case when l_suppkey % 7 = 4 then l_quantity * l_quantity / 50
            when l_shipdate >= timestamp '{SPLIT}' and l_suppkey % 7 = 5 then l_quantity * 0.3::DOUBLE
            when l_shipdate >= timestamp '{SPLIT}' and l_suppkey % 5 = 0 then l_quantity * 2
            else l_quantity end as value,
       'units' as unit, l_linenumber::BIGINT as player_count, l_shipdate as sampled_at,
       l_shipdate + to_days(l_linenumber) as imported_at, 'collector@1' as source,
       case when l_shipdate >= timestamp '{SPLIT}' then 'after' else 'before' end as side
from lineitem""",
    "v_baselines": """
select distinct 'srv' || (l_suppkey % 4) as server_id, 'b' || year(l_shipdate) as label,
       make_timestamp(year(l_shipdate), 6, 1, 0, 0, 0.0) as created_at
from lineitem""",
    "v_claimed": """
select s.*, b.label as baseline_label from v_samples s asof left join v_baselines b
on s.server_id = b.server_id and greatest(s.sampled_at, s.imported_at) <= b.created_at""",
    "v_files_parts": """
select doc_id, lang, text, n_chars,
       case when doc_id % 31 = 0 then 'sh' when doc_id % 29 = 0 then 'db' when doc_id % 23 = 0 then 'dll'
            when doc_id % 19 = 0 then 'zip' when doc_id % 17 = 0 then 'exe' when lang = 'en' then 'lua'
            when lang = 'fr' then 'js' when lang = 'de' then 'json' else 'cfg' end as ext,
       case when doc_id % 13 <> 0 then source end as resource,
       make_timestamp((1704067200 + doc_id) * 1000000) as base
from documents""",
    "v_files_before": """
select 'srv' || (doc_id % 4) as server_id, coalesce(resource, 'root') || '/' || lang || '/' || doc_id || '.' || ext as path,
       lang || '/' || doc_id || '.' || ext as name, resource, n_chars as size_bytes, sha256(text) as hash, base as modified_at
from v_files_parts""",
    "v_files_after": """
select 'srv' || (doc_id % 4) as server_id,
       coalesce(resource, 'root') || '/' || case when doc_id % 10 = 1 then 'moved/' else '' end || lang || '/' || doc_id || '.' || ext as path,
       case when doc_id % 10 = 1 then 'moved/' else '' end || lang || '/' || doc_id || '.' || ext as name,
       resource, n_chars + case when doc_id % 7 = 0 then 1 else 0 end as size_bytes,
       sha256(case when doc_id % 7 = 0 then text || 'x' else text end) as hash,
       case when doc_id % 11 = 0 then base + interval 1 day else base end as modified_at
from v_files_parts""",
    "v_diff": """
select coalesce(a.path, b.path) as path,
       case when b.path is null then 'ADDED' when a.path is null then 'DELETED' when a.hash <> b.hash then 'MODIFIED'
            when a.modified_at <> b.modified_at then 'TOUCHED' else 'UNCHANGED' end as kind,
       case when a.path is not null then a.resource else b.resource end as resource,
       b.size_bytes as before_size, a.size_bytes as after_size, b.hash as bh, a.hash as ah
from v_files_before b full outer join v_files_after a on a.path = b.path""",
    "v_findings": """
select 'fnd_' || substr(sha256('ord ' || o_orderkey), 1, 16) as id, o_orderkey as key,
       'srv' || (o_custkey % 4) as server_id, 'run' || year(o_orderdate) as run_id,
       ['CFG-MANIFEST-001', 'DEP-MISSING-001', 'PERF-LOOP-001', 'SEC-SECRET-001', 'INT-CHANGE-001', 'ERR-OTHER-001'][o_orderkey % 6 + 1] as rule_id,
       ['CONFIGURATION', 'DEPENDENCIES', 'PERFORMANCE', 'SECURITY', 'INTEGRITY', 'ERRORS'][o_orderkey % 6 + 1] as category,
       case substr(o_orderpriority, 1, 1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then 'MEDIUM'
            when '4' then 'LOW' else 'INFO' end as severity,
       (o_orderkey % 101) / 100.0::DOUBLE as confidence, 'title ' || (o_orderkey % 10) as title,
       case when o_orderkey % 90 <> 7 then 'look into it' else ' ' end as recommendation,
       case when o_orderkey % 50 <> 0 then 'c' || o_custkey end as resource,
       'f' || (o_orderkey % 7) || '.lua' as file, o_orderkey % 200 as line, o_orderdate as created_at,
       o_orderkey % 3 as evidence_count,
       case substr(o_orderpriority, 1, 1) when '1' then 4 when '2' then 3 when '3' then 2 when '4' then 1 else 0 end as sev
from orders""",
    "v_deductions": """
select *, case category when 'ERRORS' then 'RELIABILITY' else category end as health_category,
       floor(([0, 4, 10, 25, 45])[sev + 1] * confidence + 0.5)::BIGINT as points
from v_findings where floor(([0, 4, 10, 25, 45])[sev + 1] * confidence + 0.5) > 0""",
    "v_weights": """
select * from (values ('PERFORMANCE', 25), ('SECURITY', 25), ('RELIABILITY', 15), ('DEPENDENCIES', 15),
                      ('CONFIGURATION', 10), ('INTEGRITY', 10)) w(health_category, weight)""",
    "v_catalog": """
select * from (values ('CFG-MANIFEST-001', 'CONFIGURATION', 'MEDIUM'), ('CFG-MISSING-FILE-001', 'CONFIGURATION', 'HIGH'),
  ('CFG-ENSURE-MISSING-001', 'CONFIGURATION', 'HIGH'), ('DEP-MISSING-001', 'DEPENDENCIES', 'HIGH'),
  ('DEP-CYCLE-001', 'DEPENDENCIES', 'MEDIUM'), ('PERF-LOOP-001', 'PERFORMANCE', 'MEDIUM'),
  ('PERF-EVENT-001', 'PERFORMANCE', 'MEDIUM'), ('PERF-QUERY-001', 'PERFORMANCE', 'MEDIUM'),
  ('PERF-REGRESSION-001', 'PERFORMANCE', 'HIGH'), ('SEC-SECRET-001', 'SECURITY', 'HIGH'),
  ('SEC-WEBHOOK-001', 'SECURITY', 'MEDIUM'), ('SEC-OBFUSCATION-001', 'SECURITY', 'MEDIUM'),
  ('SEC-REMOTE-LOAD-001', 'SECURITY', 'HIGH'), ('SEC-DYNAMIC-EXEC-001', 'SECURITY', 'MEDIUM'),
  ('SEC-SUSPICIOUS-FILE-001', 'SECURITY', 'MEDIUM'), ('INT-CHANGE-001', 'INTEGRITY', 'INFO'))
  c(rule_id, catalog_category, default_severity)""",
    "v_targets": """
select p_partkey as p, case when p_partkey % 11 = 0 and p_partkey % 2 = 0 then 'alias' || (p_partkey // 11)
       when p_partkey % 11 = 0 and p_partkey % 3 = 0 then 'mapmanager'
       when p_partkey % 11 = 0 then 'missing' || p_partkey
       else 'n' || (p_partkey - p_partkey % 6 + (p_partkey % 6 + 1 + (p_partkey // 6) % 3) % 6) end as "to"
from part""",
    "v_dependencies": """
select 'n' || p as "from", "to", p % 50 as line from v_targets
union all select 'n' || p, "to", p % 50 + 10 from v_targets
union all select 'n' || p, '/server:' || (p % 5), p % 50 from v_targets""",
    "v_references": """
select 'n' || p as "from", 'n' || (p - p % 6 + (p + 1) % 6) as "to", p % 50 as line from v_targets
union all select 'n' || p, 'n' || p, 1 from v_targets""",
    "v_provides": """
select 'n' || p_partkey as resource, 'alias' || (p_partkey // 4) as alias, p_partkey as ord from part""",
    "v_providers": "select alias, arg_min(resource, ord) as provider from v_provides group by alias",
    "v_edges": """
select "from", "to", kind, min(line) as line from (
  select "from", "to", 'DECLARED' as kind, line from v_dependencies where "to" not like '/%'
  union all select "from", "to", 'DISCOVERED', line from v_references where "to" <> "from") group by all""",
    "v_resolved": """
select e."from", e."to", e.kind, e.line, case when n.p_partkey is not null then e."to" else v.provider end as target,
       (n.p_partkey is not null or v.provider is not null) as resolved
from v_edges e left join part n on e."to" = 'n' || n.p_partkey left join v_providers v on e."to" = v.alias""",
    "v_arcs": 'select distinct "from" as src, target as dst from v_resolved where resolved',
    "v_event_facts": """
select event_id as id, 'u' || user_id as resource, 'f' || (event_id % 9) || '.lua' as file, event_id % 500 as line,
       case when event_id % 2 = 0 then 'server' else 'client' end as side,
       case when k % 3 = 0 then 'REGISTRATION' else 'TRIGGER' end as kind, event_type as call,
       case when k % 17 <> 0 then 'e' || (k % 40) end as event,
       case event_type when 'signup' then 'to-server' when 'view' then 'to-client' else 'local' end as direction,
       (event_type = 'view' and event_id % 2 = 0) as broadcast, event_id % 700 as loop_line
from (select *, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) as k from events)""",
    "v_event_graph": """
select event, count(*) filter (kind = 'REGISTRATION') as registrations, count(*) filter (kind <> 'REGISTRATION') as triggers,
       bool_or(broadcast) as broadcast, bool_or(direction in ('to-server', 'to-client')) as network
from v_event_facts where event is not null group by event""",
    "v_directives": """
select 'srv' || (user_id % 4) as server_id, case when user_id % 37 = 1 then 'mapmanager'
       when event_id % 29 = 0 then '[g' || (user_id % 5) || ']' else 'u' || user_id end as target,
       event_id as line, case when event_type = 'error' then 'stop' else 'ensure' end as command
from events""",
    "v_loops": """
select o_orderkey as id, 'c' || o_custkey as resource, 'f' || (o_custkey % 9) || '.lua' as file, o_orderkey as line,
       ['WHILE', 'FOR', 'REPEAT'][o_orderkey % 3 + 1] as kind, o_orderkey % 2 = 0 as continuous, o_orderkey % 3 = 0 as yields,
       case when o_orderkey % 4 <> 1 then o_orderkey % 120 end as wait_ms, o_orderkey % 4 as opaque_calls,
       o_custkey % 2 = 0 as inside_thread, o_custkey % 10 = 0 as unbalanced,
       case when o_orderkey % 5 <> 0 then ['FOR', 'WHILE', 'REPEAT'][o_orderkey % 3 + 1] end as loop_kind,
       ['MySQL.query', 'oxmysql.fetch', 'print', 'exports.oxmysql:execute'][o_orderkey % 4 + 1] as call,
       (['SELECT * FROM t', 'select a from t where b = 1', 'SELECT * FROM t LIMIT 5', 'UPDATE t SET a = 1', 'select a from t', NULL])
         [floor(o_totalprice)::BIGINT % 6 + 1] as sql
from orders""",
    "v_scripts": """
select 'd' || doc_id as file, coalesce(text, '') || chr(10) || 'PerformHttpRequest("http://' || source || '/' || doc_id || '", function(code, body)' || repeat(chr(10), doc_id % 80)
       || 'run(load(decode(body, -1), {1, "x"}, 0x1F)()) end)' || chr(10) || 'SaveResourceFile(self:name (), ''' || (['helper.exe', 'config.json', 'bin/run.SH'])[doc_id % 3 + 1]
       || ''', data[1], -1)' || chr(10) || 'require "m' || (doc_id % 5) || '" -- load(dead)' || chr(10) || 'print{text} a().load(x) load("k", -2.5)(' as text
from documents where doc_id is not null and source is not null
union all select 'p' || page_id, html from pages""",
    "v_calls": """
select 'd' || doc_id as file, line, (['PerformHttpRequest', 'load', 'require', 'print', 'SaveResourceFile', 'loadstring',
       'http.request', 'warn', 'io.open', 'emit', 'log'])[(doc_id * 31 + line * 7) % 11 + 1] as name,
       case when (doc_id * 31 + line * 7) % 3 <> 0 then (['a.exe', 'data', 'b.lua', 'run.sh', 'x.DLL'])[(doc_id * 31 + line * 7) % 5 + 1] end as arg,
       (doc_id * 31 + line * 7) % 2 = 0 as has_non_literal
from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, in dependency order."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                visit(VIEWS[name])
                wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"
