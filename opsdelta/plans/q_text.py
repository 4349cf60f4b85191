"""Corpus scanning and code fact queries, and the rule registry."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, mask_secret
from ..operators import calls as CS
from ..operators import code_rules as CR
from ..operators import text as TX
from ..rules import Registry
from . import q_graphs as QG
from . import views as V
from .registry import fnd, jsr, query

# RE2 knows neither back-references nor look-around: word boundaries are \b
# (ASCII there), and the quoted assignment is written once per quote.
_KEY = fixed.SENSITIVE_KEY


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _redact_sql(expr: str) -> str:
    steps = []
    for name, pattern, replacement in fixed.REDACTIONS:
        r = replacement.replace("$1", "\\1").replace("$2", "\\2")
        if name == "sensitive-assignment":
            for quote in "\"'`":
                steps.append((f"(?i)([\"'`]?{_KEY}[\"'`]?\\s*(?:=|:|=>)\\s*){quote}[^\"'`\\n]+{quote}", f"\\1{quote}{fixed.MASK}{quote}"))
        elif name == "sensitive-assignment-unquoted":
            steps.append((f"(?i)(\\b{_KEY}\\s*(?:=|:)\\s*)([^\\s\"'`;,)=>][^\\s\"'`;,)]*)", r))
        else:
            p = pattern.replace("(?<![a-z0-9+.-])[0-9+.-]*+", "").replace("*+", "*").replace("++", "+").replace(fixed.NB, r"\b").replace("(?<=[A-Za-z0-9_])" + fixed.NA, r"\b").replace("(?=[A-Za-z0-9_])", "")
            steps.append((p, r))
    for p, r in steps:
        expr = f"regexp_replace({expr}, {_q(p)}, {_q(r)}, 'g')"
    return expr


@query("redact_documents", f"select doc_id, {_redact_sql('text')} as text from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", TX.redact_text("text").alias("text"))


@query("secret_documents", f"select doc_id, {_redact_sql('text')} <> text as has_secret from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", TX.contains_secret("text").alias("has_secret"))


KEYED = r"""(?i)(?:api[_-]?key|access[_-]?key|auth[_-]?token|secret|token)\s*(?:=>|=|:)\s*["''`]([^"''`\n]{4,})["''`]"""


@query(
    "scan_secrets",
    f"""select doc_id, 'API_KEY' as kind, line, case when regexp_matches(v, '{TX.PLACEHOLDER}') then 0.25::DOUBLE
    else {jsr("0.7::DOUBLE - case when len(list_distinct(string_split(v, ''))) < 6 then 0.2::DOUBLE else 0 end", 2)} end as confidence,
    substr(v, 1, least(4, length(v) // 4)) || '{fixed.MASK}' as masked_value
    from (select doc_id, line, unnest(regexp_extract_all(content, '{KEYED}', 1)) as v
      from (select doc_id, unnest(string_split_regex(text, '\\r?\\n')) as content, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) as line from documents))""",
)
def _(spark, sf):
    return TX.scan_secrets(V.table(spark, sf, "documents")).select("doc_id", "kind", "line", "confidence", "masked_value")


@query(
    "secret_findings",
    f"""select {fnd("'SEC-SECRET-001'", "''", "id", "line", "'API_KEY:' || line || ':' || at_col")} as id, 'SEC-SECRET-001' as rule_id,
    case when regexp_matches(x, '{TX.PLACEHOLDER}') then 'LOW' else 'HIGH' end as severity,
    case when regexp_matches(x, '{TX.PLACEHOLDER}') then 0.25::DOUBLE else {jsr("0.7::DOUBLE - case when len(list_distinct(string_split(x, ''))) < 6 then 0.2::DOUBLE else 0 end", 2)} end as confidence,
    id as doc_id, line from (select id, line, regexp_extract(hits[i], '{KEYED}', 1) as x,
      1 + list_sum(list_transform(list_slice(pieces, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: length(x))), 0) as at_col
      from (select id, line, hits, pieces, unnest(range(1, len(hits) + 1)) as i from (select id, line, regexp_extract_all(content, '{KEYED}') as hits, string_split_regex(content, '{KEYED}') as pieces
      from (select id, unnest(string_split_regex(text, '\\r?\\n')) as content, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) as line
        from (select doc_id as id, text from documents union all select page_id, html from pages)))))""",
)
def _(spark, sf):
    turns = V.table(spark, sf, "documents").select("doc_id", "text").unionByName(
        V.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    )
    return TX.secret_findings(TX.scan_secrets(turns))


# Secrets of every kind, planted in a last line of the documents; built from parts here,
# so that none stands in this file. (kind, text before, value, text after, confidence)
_H = "md5('k' || doc_id)"
PLANTED = [
    ("DISCORD_WEBHOOK", "hook ", f"'https://dis' || 'cord.com/api/webhooks/123/' || {_H}", " here", 0.9),
    ("PRIVATE_KEY", "", "'-----BEGIN ' || 'PRIVATE KEY-----'", "", 0.9),
    ("JWT", "jwt é ", f"'ey' || 'J' || {_H} || '.' || {_H} || '.' || {_H}", ".", 0.9),
    ("DISCORD_BOT_TOKEN", "bot: ", f"substr({_H}, 1, 24) || '.' || substr({_H}, 1, 6) || '.' || {_H}", "!", 0.9),
    ("URI_CREDENTIALS", "mysql://joe:", _H, "@host/db", 0.9),
    ("AUTHORIZATION_HEADER", "authorization: bearer ", _H, "", 0.9),
    ("GENERIC_WEBHOOK", "", f"'https://a.b/web' || 'hooks/' || {_H}", " x", 0.9),
    ("LICENCE_KEY", "license_key = \"", f"repeat({_H}, 20)", "\"", 0.7),
    ("PASSWORD", "the password: \"", f"repeat({_H}, 3)", "\" and", 0.7),
    ("API_KEY", "api_key => \"", _H, "\"", 0.7),
]


def _case(expr) -> str:
    return "case doc_id % 10 " + " ".join(f"when {i} then {expr(p)}" for i, p in enumerate(PLANTED)) + " end"


_PLANTED_LINE = _case(lambda p: f"'{p[1]}' || {p[2]} || '{p[3]}'")
_PLANTED_VALUE = _case(lambda p: p[2])


@query(
    "scan_secret_kinds",
    f"""select doc_id, {_case(lambda p: f"'{p[0]}'")} as kind, 1::BIGINT as line, {_case(lambda p: f"{p[4]}::DOUBLE")} as confidence,
    substr(v, 1, least(4, length(v) // 4)) || '{fixed.MASK}' as masked_value, false as leaks
    from (select doc_id, {_PLANTED_VALUE} as v from documents)""",
)
def _(spark, sf):
    """A line with a secret in front of each document; `leaks` if a planted value is in any column."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", F.expr(_PLANTED_LINE), "text").alias("text"))
    found = TX.scan_secrets(docs).where("line = 1")
    value = F.expr(_PLANTED_VALUE)
    return found.select("doc_id", "kind", "line", "confidence", "masked_value", (F.contains("redacted_excerpt", value) | F.contains("masked_value", value)).alias("leaks"))


@query(
    "mask_tokens",
    f"""select doc_id, substr(w, 1, least(4, length(w) // 4)) || '{fixed.MASK}' as masked, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{{12,}}')) as w from documents) group by 1, 2""",
)
def _(spark, sf):
    words = V.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]{12,})"), 1)).alias("w"))
    return words.select("doc_id", mask_secret("w").alias("masked")).groupBy("doc_id", "masked").agg(F.count(F.lit(1)).alias("n"))


@query(
    "redact_map",
    f"""select event_id, event_type as "user_name", '{fixed.MASK}' as db_password, '{fixed.MASK}' as "apiKey",
    'token = "{fixed.MASK}"' as note from events""",
)
def _(spark, sf):
    m = F.create_map(
        F.lit("user_name"), F.col("event_type"), F.lit("db_password"), F.col("props"), F.lit("apiKey"), V.pre("k", "event_id"),
        F.lit("note"), F.concat(F.lit('token = "'), V.pre("abc", "event_id"), F.lit('"')),
    )
    rows = V.table(spark, sf, "events").select("event_id", TX.redact_map(m).alias("m"))
    return rows.select("event_id", *[F.col("m")[k].alias(k) for k in ("user_name", "db_password", "apiKey", "note")])


_STR = r"""("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')"""
_KW = "(" + ", ".join(f"'{k}'" for k in TX.KEYWORDS) + ")"
_DEC = r"(?i)\b(?:FromBase64|from_base64|base64Decode|b64decode|DecodeString|Decrypt|Inflate|Decompress)\b"
FEATURES = f"""(select key, len(s)::BIGINT as strings, len(list_filter(s, lambda x: regexp_matches(x, '^["''][A-Za-z0-9+/]{{32,}}={{0,2}}["'']$')))::BIGINT as encoded_strings,
  len(list_filter(s, lambda x: regexp_matches(x, '(?:\\\\(?:\\d{{1,3}}|x[0-9a-fA-F]{{2}})){{8}}')))::BIGINT as escaped_strings,
  regexp_matches(text, '{_DEC}') and regexp_matches(text, '\\b(?:load|loadstring|RunString|dofile)\\s*\\(') as decode_chain,
  len(regexp_extract_all(text, 'string\\.char\\s*\\('))::BIGINT as char_calls,
  len(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: length(x) > 2000))::BIGINT as long_lines,
  len(n)::BIGINT as names, len(list_filter(n, lambda x: regexp_matches(x, '^(?:_0x[0-9a-f]+|[Il1O0]{{6,}}|[a-zA-Z]{{1,2}}\\d{{4,}})$')))::BIGINT as opaque_names
  from (select key, text, regexp_extract_all(text, '{_STR}', 1) as s,
    list_filter(regexp_extract_all(regexp_replace(text, '{_STR}', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: x not in {_KW}) as n
    from (select 'd' || doc_id as key, text from documents union all select 'p' || page_id, html from pages)))"""


def corpus(spark, sf):
    return V.table(spark, sf, "documents").select(V.pre("d", "doc_id").alias("key"), "text").unionByName(
        V.table(spark, sf, "pages").select(V.pre("p", "page_id").alias("key"), F.col("html").alias("text"))
    )


@query("obfuscation_features", f"select * from {FEATURES}")
def _(spark, sf):
    return TX.obfuscation_features(corpus(spark, sf), "key")


@query(
    "obfuscation_score",
    f"""select key, {jsr('total', 2)} as score, total >= 0.3::DOUBLE - 1e-12::DOUBLE as reportable,
    case when total >= 0.3::DOUBLE - 1e-12::DOUBLE then {jsr('least(0.85::DOUBLE, 0.4::DOUBLE + total * 0.5::DOUBLE)', 2)} end as confidence from (
    select key, least(1.0::DOUBLE, case when decode_chain then 0.45::DOUBLE else 0 end
     + case when strings >= 8 and encoded_strings::DOUBLE / strings >= 0.25 then 0.3::DOUBLE else 0 end
     + case when names >= 20 and opaque_names::DOUBLE / names >= 0.4 then 0.25::DOUBLE else 0 end + case when char_calls >= 5 then 0.2::DOUBLE else 0 end
     + case when escaped_strings >= 3 then 0.2::DOUBLE else 0 end + case when long_lines > 0 then 0.1::DOUBLE else 0 end) as total from {FEATURES})""",
)
def _(spark, sf):
    s = TX.obfuscation_score(TX.obfuscation_features(corpus(spark, sf), "key"))
    return s.select("key", "score", "reportable", "confidence")


_PAGES = "(select page_id as file, html as text from pages)"


@query(
    "call_sites",
    f"select file as page_id, line, name, len(string_args)::bigint as string_count, number_args, has_non_literal from {CS.sites_sql(_PAGES)}",
)
def _(spark, sf):
    c = CS.call_sites(V.table(spark, sf, "pages"), "page_id", "html")
    return c.select("page_id", "line", "name", F.size("string_args").cast("bigint").alias("string_count"), "number_args", "has_non_literal")


_SCRIPTS = CS.sites_sql("v_scripts")


@query("script_calls", f"select * from {_SCRIPTS}")
def _(spark, sf):
    return CS.call_sites(V.scripts(spark, sf), "file", "text")


# ------------------------------------------------------------- code facts

_LOADERS = "('load', 'loadstring', 'RunString', 'dofile', 'require')"
PAIRS = f"""(select f.file, f.line as fetch_line, f.name as fetch_call, l.line as loader_line, l.name as loader_call, l.line - f.line as distance
  from v_calls f join v_calls l on f.file = l.file and l.line - f.line between 0 and 60
  where f.name in ('PerformHttpRequest', 'http.request', 'fetch') and l.name in {_LOADERS})"""


@query("proximity_pairs", f"select * from {PAIRS}")
def _(spark, sf):
    return CR.proximity_pairs(V.calls(spark, sf)).select("file", "fetch_line", "fetch_call", "loader_line", "loader_call", "distance")


@query(
    "remote_loads",
    f"""select {fnd("'SEC-REMOTE-LOAD-001'", "''", "file", "fetch_line", "'remote-load:' || fetch_line")} as id, 'SEC-REMOTE-LOAD-001' as rule_id, file, fetch_line as line, fetch_call,
    count(*) as loader_count, min(distance) as distance, 'HIGH' as severity, case when min(distance) <= 10 then 0.8::DOUBLE else 0.6::DOUBLE end as confidence
    from {PAIRS} group by file, fetch_line, fetch_call""",
)
def _(spark, sf):
    return CR.remote_loads(CR.proximity_pairs(V.calls(spark, sf)))


@query(
    "dynamic_exec",
    f"""select file, line, name, 'MEDIUM' as severity, 0.75::DOUBLE as confidence from v_calls
    where name in {_LOADERS} and name <> 'require' and (arg is null or has_non_literal)""",
)
def _(spark, sf):
    return CR.dynamic_exec(V.calls(spark, sf))


@query(
    "executable_writes",
    """select file, line, name, arg as target from v_calls where name in ('SaveResourceFile', 'io.open', 'io.write')
    and regexp_matches(arg, '(?i)\\.(exe|dll|so|dylib|bat|cmd|ps1|sh|scr|vbs|jar)$')""",
)
def _(spark, sf):
    return CR.executable_writes(V.calls(spark, sf))


_SCRIPT_PAIRS = f"""(select f.file, f.line as fetch_line, f.name as fetch_call, l.line as loader_line, l.line - f.line as distance
  from {_SCRIPTS} f join {_SCRIPTS} l on f.file = l.file and l.line - f.line between 0 and 60
  where f.name in ('PerformHttpRequest', 'http.request', 'fetch') and l.name in {_LOADERS})"""


@query(
    "script_remote_loads",
    f"""select {fnd("'SEC-REMOTE-LOAD-001'", "''", "file", "fetch_line", "'remote-load:' || fetch_line")} as id, 'SEC-REMOTE-LOAD-001' as rule_id, file, fetch_line as line, fetch_call,
    count(*) as loader_count, min(distance) as distance, 'HIGH' as severity, case when min(distance) <= 10 then 0.8::DOUBLE else 0.6::DOUBLE end as confidence
    from {_SCRIPT_PAIRS} group by file, fetch_line, fetch_call""",
)
def _(spark, sf):
    return CR.remote_loads(CR.proximity_pairs(CS.call_sites(V.scripts(spark, sf), "file", "text")))


@query(
    "script_dynamic_exec",
    f"""select {fnd("'SEC-DYNAMIC-EXEC-001'", "''", "file", "line", "'dynamic-exec:' || line")} as id, 'SEC-DYNAMIC-EXEC-001' as rule_id, file, line, name, 'MEDIUM' as severity, 0.75::DOUBLE as confidence
    from {_SCRIPTS} where name in {_LOADERS} and name <> 'require' and (len(string_args) = 0 or has_non_literal)""",
)
def _(spark, sf):
    return CR.dynamic_exec_findings(CS.call_sites(V.scripts(spark, sf), "file", "text"))


@query(
    "script_executable_writes",
    f"""select {fnd("'SEC-SUSPICIOUS-FILE-001'", "''", "file", "line", "'file-write:' || line")} as id, 'SEC-SUSPICIOUS-FILE-001' as rule_id, file, line, name, target, 'HIGH' as severity, 0.7::DOUBLE as confidence
    from (select *, list_filter(string_args, lambda x: contains(x, '.'))[1] as target from {_SCRIPTS} where name in ('SaveResourceFile', 'io.open', 'io.write'))
    where regexp_matches(target, '(?i)\\.(exe|dll|so|dylib|bat|cmd|ps1|sh|scr|vbs|jar)$')""",
)
def _(spark, sf):
    return CR.executable_write_findings(CS.call_sites(V.scripts(spark, sf), "file", "text"))


@query(
    "suspicious_files",
    """select path, case ext when '.exe' then 'EXECUTABLE' when '.sh' then 'HOST_SCRIPT' when '.zip' then 'ARCHIVE' when '.dll' then 'NATIVE_MODULE' else 'DATABASE' end as kind,
    ext as extension, size_bytes, case ext when '.exe' then 0.9::DOUBLE when '.sh' then 0.8::DOUBLE when '.zip' then 0.4::DOUBLE when '.dll' then 0.35::DOUBLE else 0.3::DOUBLE end as confidence
    from (select *, regexp_extract(path, '(\\.[^.]*)$', 1) as ext from v_files_after) where ext in ('.exe', '.sh', '.zip', '.dll', '.db')""",
)
def _(spark, sf):
    return CR.suspicious_files(V.files(spark, sf, "after"))


@query(
    "loop_findings",
    f"""select {fnd("'PERF-LOOP-001'", "resource", "file", "line", "'loop-' || line")} as id, 'PERF-LOOP-001' as rule_id, file, line, kind,
    case when inside_thread then 'HIGH' else 'MEDIUM' end as severity, case when unbalanced then 0.5::DOUBLE when opaque_calls > 0 then 0.75::DOUBLE else 0.9::DOUBLE end as confidence
    from v_loops where continuous and not yields""",
)
def _(spark, sf):
    return CR.loop_findings(V.loops(spark, sf))


@query(
    "hot_events",
    """select e.id, e.event, e.file, e.line, e.loop_line, l.wait_ms, 'MEDIUM' as severity, case when l.wait_ms is null then 0.7::DOUBLE else 0.85::DOUBLE end as confidence
    from v_event_facts e join v_loops l on l.file = e.file and l.line = e.loop_line
    where e.kind = 'TRIGGER' and e.direction <> 'local' and l.continuous and (not l.yields or coalesce(l.wait_ms < 50, false))""",
)
def _(spark, sf):
    return CR.hot_events(V.event_facts(spark, sf), V.loops(spark, sf))


@query(
    "query_findings",
    r"""with q as (select *, regexp_matches(coalesce(sql, ''), '(?i)^\s*select\b') and not regexp_matches(coalesce(sql, ''), '(?i)\b(where|limit)\b') as unbounded,
      regexp_matches(coalesce(sql, ''), '(?i)\bselect\s+\*') as star from v_loops where call like 'MySQL.%' or call like 'oxmysql.%' or call like 'exports.oxmysql:%')
    select file, line, call, 'query-loop' as "check", case when loop_kind = 'FOR' then 'MEDIUM' else 'HIGH' end as severity,
      case when loop_kind = 'FOR' then 0.8::DOUBLE else 0.85::DOUBLE end as confidence from q where loop_kind is not null
    union all select file, line, call, 'query-unbounded', 'LOW', 0.6::DOUBLE from q where unbounded
    union all select file, line, call, 'query-star', 'INFO', 0.5::DOUBLE from q where star and not unbounded""",
)
def _(spark, sf):
    return CR.query_findings(V.loops(spark, sf))


@query(
    "enclosing_interval",
    """with l as (select 's' || o_custkey as file, epoch_us(o_orderdate) // 86400000000 as lo, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 400 as hi from orders),
    p as (select 's' || l_suppkey as file, l_orderkey * 8 + l_linenumber as id, epoch_us(l_shipdate) // 86400000000 as at_line from lineitem)
    select p.file, p.id, p.at_line, max(l.lo) as loop_start, count(distinct p.file) as n from p left join l on p.file = l.file and p.at_line >= l.lo and p.at_line < l.hi
    group by p.file, p.id, p.at_line""",
)
def _(spark, sf):
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000).cast("bigint")
    loops = V.table(spark, sf, "orders").select(V.pre("s", "o_custkey").alias("file"), day("o_orderdate").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 400).alias("end"))
    at = V.table(spark, sf, "lineitem").select(V.pre("s", "l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), day("l_shipdate").alias("at"))
    found = CR.enclosing(at.distinct(), loops)
    return found.select("file", "id", F.col("at").alias("at_line"), "loop_start", F.lit(1).cast("bigint").alias("n"))


# ---------------------------------------------------------- pluggable rules


def registry() -> Registry:
    reg = Registry()

    def normal(df: DataFrame, resource: str, file: str | None) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select("id", F.col(resource).alias("resource") if resource else none.alias("resource"), F.col(file).alias("file") if file else none.alias("file"), "severity", "confidence")

    reg.register("DEP-MISSING-001", "DEPENDENCIES", lambda s, sf: normal(
        QG.GR.missing_dependencies(QG.GR.unresolved(QG.edges(s, sf), V.nodes(s, sf), QG.provided(s, sf))), "resource", None))
    reg.register("PERF-LOOP-001", "PERFORMANCE", lambda s, sf: normal(CR.loop_findings(V.loops(s, sf)), None, "file"))
    reg.register("CFG-MISSING-FILE-001", "CONFIGURATION", lambda s, sf: normal(QG.CF.missing_files(QG.declared(s, sf), QG.owned_files(s, sf)), "resource", None))
    reg.register("SEC-REMOTE-LOAD-001", "SECURITY", lambda s, sf: normal(CR.remote_loads(CR.proximity_pairs(V.calls(s, sf))), None, "file"))
    return reg


@query(
    "rule_registry",
    f"""select rule_id, category, severity, count(*) as finding_count from (
    select 'DEP-MISSING-001' as rule_id, 'DEPENDENCIES' as category, case when lower("to") in {QG.BUNDLED} then 'INFO' else 'HIGH' end as severity from v_resolved where not resolved
    union all select 'CFG-MISSING-FILE-001', 'CONFIGURATION', case when pattern like '%*%' or pattern like '%?%' then 'MEDIUM' else 'HIGH' end from {QG.DECLARED} d
      where not exists (select 1 from v_files_after f where f.resource = d.resource and regexp_matches(f.name, d.rx))
    union all select 'SEC-REMOTE-LOAD-001', 'SECURITY', 'HIGH' from (select distinct file, fetch_line, fetch_call from {PAIRS})) group by 1, 2, 3""",
)
def _(spark, sf):
    found = registry().run(spark, sf, disabled=["PERF-LOOP-001"])
    return found.groupBy("rule_id", "category", "severity").agg(F.count(F.lit(1)).alias("finding_count"))


query("redact_variables", QG._variables_sql())(QG.redact_variables)
