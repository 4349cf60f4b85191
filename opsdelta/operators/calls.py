"""Calls in script text, nested and sugared ones included.

A document's text becomes a stream of tokens. Running sums over that stream give each
token its line and its bracket depth, so the arguments of a call are the tokens one
level below its bracket, found as those whose last opened bracket of that level it is.
All of it needs one shuffle, of the tokens by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import KEYWORDS, STRING_LITERAL

_STRING = STRING_LITERAL[1:-1]
_NUMBER = r"0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.:][A-Za-z_][A-Za-z0-9_]*+)*+"
#: A line comment, string, qualified name, number, bracket or mark, run of line breaks, or other characters.
TOKEN = rf"--[^\n]*+|{_STRING}|{_NAME}|{_NUMBER}|[\[\](){{}},.:-]|\n++|[^\x09-\x0D\x20\"'A-Za-z0-9_\[\](){{}},.:-]++|[\"']"
_GAP = r"[^\n\"'0-9A-Za-z_\[\](){}-]++"
#: Names and marks between them, but for the last two names: what a call or a number looks back at stays apart.
_PROSE = rf"(?:{_NAME}{_GAP}(?={_NAME}{_GAP}{_NAME}))++"
#: Without a name before a bracket or a string a text has no call.
MAY_CALL = r"[A-Za-z0-9_][\x09-\x0D\x20]*+[\"'({]"


def _is_name(token: Column) -> Column:
    return token.rlike("^[A-Za-z_]") & ~F.regexp_extract(token, "^[A-Za-z0-9_]+", 0).isin(KEYWORDS)


def token_stream(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, step, line, depth) without blanks and comments; depth is that before the token.

    Prose is one token a stretch, taken where the first of its names would be: to the calls
    around it a stretch says no more than one name does.
    """
    found = docs.where(F.col(text).rlike(MAY_CALL)).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"{_PROSE}|{TOKEN}"), 0)).alias("pos", "token"))
    # comments count nothing, and of a stretch of prose its first letter is enough
    found = found.where(~F.startswith("token", F.lit("--"))).withColumn(
        "token", F.when(F.col("token").rlike("^[A-Za-z_].*[^A-Za-z0-9_.:]"), F.substring("token", 1, 1)).otherwise(F.col("token"))
    )
    step = F.when(F.col("token").isin("(", "[", "{"), 1).when(F.col("token").isin(")", "]", "}"), -1).otherwise(0)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.when(F.startswith("token", F.lit("\n")), F.length("token")).otherwise(0)
    placed = found.select(
        key, "pos", "token", step.alias("step"),
        (1 + F.coalesce(F.sum(breaks).over(before), F.lit(0))).alias("line"), F.coalesce(F.sum(step).over(before), F.lit(0)).alias("depth"),
    )
    return placed.where(~F.startswith("token", F.lit("\n")))


def call_sites(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per call: (key, line, name, string_args, number_args, has_non_literal).

    A call is a qualified name, not itself behind a dot or colon, before a bracket, a string
    or a table. Arguments are literals at its own level; anything else there but commas, signs
    of numbers and brackets makes it non-literal, as a table in place of the bracket does. An
    open bracket that is never closed takes all that follows. `key` must tell documents apart;
    a null text has no calls. Names of several parts are written without blanks.
    """
    t, step = F.col("token"), F.col("step")
    order = Window.partitionBy(key).orderBy("pos")
    before, further, after = F.lag("token", 1).over(order), F.lag("token", 2).over(order), F.lead("token", 1).over(order)
    level = F.col("depth") + F.when(step == 1, 1).otherwise(0)
    seen = token_stream(docs, key, text).select(
        key, "pos", "token", "step", level.alias("level"), before.alias("before"), further.alias("further"), after.alias("after"),
        F.lag("line", 1).over(order).alias("head_line"),
    )
    string = t.rlike("^([\"']).*\\1$") & (F.length("token") > 1)
    heads = t.isin("(", "{") | string
    called = heads & _is_name(F.col("before")) & ~F.coalesce(F.col("further").isin(".", ":"), F.lit(False))
    inside = Window.partitionBy(key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = t.rlike("^[0-9]")
    signed = (F.col("before") == "-") & F.coalesce(F.col("further").isin("(", ","), F.lit(True))
    literal = string | number | (t == ",") | ((t == "-") & F.coalesce(F.col("after").rlike("^[0-9]"), F.lit(False)))
    marked = seen.select(
        key, "pos", "step",
        F.last(F.when(step == 1, F.col("pos")), ignorenulls=True).over(inside).alias("enclosing"),
        F.when(called, F.struct(F.col("before").alias("name"), F.col("head_line").alias("line"), (t == "{").alias("table"))).alias("head"),
        F.when(string, F.substr(t, F.lit(2), F.length(t) - 2)).alias("text"),
        F.when(number, F.when(signed, F.concat(F.lit("-"), t)).otherwise(t)).alias("number"),
        ((step == 0) & ~literal).alias("other"),
    )
    # an opened bracket stands for its own call, a string for that it is the sugared argument of and for the one around it
    own = F.when((step == 1) | F.col("head").isNotNull(), F.struct(F.col("pos").alias("site"), F.col("head").alias("head")))
    around = F.when((step == 0) & F.col("enclosing").isNotNull(), F.struct(F.col("enclosing").alias("site"), F.lit(None).cast("struct<name:string,line:bigint,table:boolean>").alias("head")))
    member = marked.select(key, "pos", "text", "number", "other", F.explode(F.array_compact(F.array(own, around))).alias("m"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda x: x[c])
    sites = member.groupBy(key, F.col("m.site").alias("site")).agg(
        F.max("m.head").alias("head"), in_order("text").alias("strings"), in_order("number").alias("numbers"), F.bool_or("other").alias("other")
    )
    none = F.array().cast("array<string>")
    table = F.col("head.table")
    return sites.where("head is not null").select(
        key, F.col("head.line").alias("line"), F.col("head.name").alias("name"),
        F.when(table, none).otherwise(F.col("strings")).alias("string_args"), F.when(table, none).otherwise(F.col("numbers")).alias("number_args"),
        (table | F.col("other")).alias("has_non_literal"),
    )


def sites_sql(source: str) -> str:
    """The same in DuckDB SQL over a relation (file, text): file, line, name, string_args, number_args, has_non_literal."""
    kw = "(" + ", ".join(f"'{k}'" for k in KEYWORDS) + ")"
    token = TOKEN.replace("*+", "*").replace("++", "+").replace("'", "''")
    name = "(regexp_matches({0}, '^[A-Za-z_]') and regexp_extract({0}, '^[A-Za-z0-9_]+') not in " + kw + ")"
    is_string = "(length(token) > 1 and token[1] in ('\"', '''') and token[1] = token[-1])"
    return f"""(with stream as (
      select file, pos, found[pos] as token, case when found[pos] in ('(', '[', '{{') then 1 when found[pos] in (')', ']', '}}') then -1 else 0 end as step
      from (select file, found, unnest(range(1, len(found) + 1)) as pos from (select file, regexp_extract_all(text, '{token}') as found from {source}))),
    placed as (
      select *, 1 + coalesce(sum(case when token[1] = chr(10) then length(token) else 0 end) over w, 0) as line, coalesce(sum(step) over w, 0) as depth
      from stream window w as (partition by file order by pos rows between unbounded preceding and 1 preceding)),
    seen as (
      select *, lag(token) over w as before, lag(token, 2) over w as further, lead(token) over w as after, lag(line) over w as head_line, depth + (step = 1)::int as level, {is_string} as is_string
      from placed where token[1] <> chr(10) and token[1:2] <> '--' window w as (partition by file order by pos)),
    marked as (
      select *, max(case when step = 1 then pos end) over (partition by file, level order by pos) as enclosing,
        (token in ('(', '{{') or is_string) and before is not null and {name.format('before')} and coalesce(further not in ('.', ':'), true) as called,
        regexp_matches(token, '^[0-9]') as is_number, before = '-' and coalesce(further in ('(', ','), true) as signed from seen),
    argument as (
      select file, enclosing as site, pos, case when is_string then token[2:-2] end as text, case when is_number then case when signed then '-' else '' end || token end as number,
        not (is_string or is_number or token = ',' or (token = '-' and coalesce(regexp_matches(after, '^[0-9]'), false))) as other
      from marked where step = 0 and enclosing is not null
      union all select file, pos, pos, token[2:-2], null, false from marked where called and is_string),
    folded as (
      select file, site, list(text order by pos) filter (text is not null) as texts, list(number order by pos) filter (number is not null) as numbers, bool_or(other) as other
      from argument group by file, site)
    select m.file, m.head_line::bigint as line, m.before as name, case when token = '{{' or texts is null then []::varchar[] else texts end as string_args,
      case when token = '{{' or numbers is null then []::varchar[] else numbers end as number_args, token = '{{' or coalesce(other, false) as has_non_literal
    from marked m left join folded f on f.file = m.file and f.site = m.pos where called)"""
