"""Rules over code facts: calls, loops, queries and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finding_id, fixed
from .joins import interval_join, near_join

REACH_LINES = 60
FRAME_MS = 50


def proximity_pairs(calls: DataFrame, reach: int = REACH_LINES) -> DataFrame:
    """Fetches paired with the code loaders 0 to `reach` lines below them."""
    fetches = calls.where(F.col("name").isin(fixed.FETCH_CALLS)).select(
        "file", F.col("line").alias("fetch_line"), F.col("name").alias("fetch_call")
    )
    loaders = calls.where(F.col("name").isin(fixed.LOADER_CALLS)).select(
        "file", F.col("line").alias("loader_line"), F.col("name").alias("loader_call")
    )
    pairs = near_join(fetches, loaders, ["file"], F.col("fetch_line"), F.col("loader_line"), 0, reach)
    return pairs.withColumnRenamed("_delta", "distance")


def remote_loads(pairs: DataFrame) -> DataFrame:
    """One HIGH finding per fetch that reaches a loader; near ones are surer."""
    rule = F.lit("SEC-REMOTE-LOAD-001")
    grouped = pairs.groupBy("file", "fetch_line", "fetch_call").agg(
        F.count(F.lit(1)).alias("loader_count"), F.min("distance").alias("distance")
    )
    return grouped.select(
        finding_id(rule, F.lit(""), "file", "fetch_line", F.concat(F.lit("remote-load:"), F.col("fetch_line").cast("string"))).alias("id"),
        rule.alias("rule_id"),
        "file",
        F.col("fetch_line").alias("line"),
        "fetch_call",
        "loader_count",
        "distance",
        F.lit("HIGH").alias("severity"),
        F.when(F.col("distance") <= 10, 0.8).otherwise(0.6).alias("confidence"),
    )


def dynamic_exec(calls: DataFrame) -> DataFrame:
    """Loaders (but `require`) whose input is not purely literal."""
    literal = (F.size("string_args") > 0) & ~F.col("has_non_literal")
    loaders = [c for c in fixed.LOADER_CALLS if c != "require"]
    return calls.where(F.col("name").isin(loaders) & ~literal).select(
        "file", "line", "name", F.lit("MEDIUM").alias("severity"), F.lit(0.75).alias("confidence")
    )


def executable_writes(calls: DataFrame) -> DataFrame:
    """Writes whose first argument with a dot names an executable."""
    target = F.try_element_at(F.filter("string_args", lambda a: F.instr(a, ".") > 0), F.lit(1))
    return (
        calls.where(F.col("name").isin(fixed.FILE_WRITE_CALLS))
        .withColumn("target", target)
        .where(F.col("target").rlike(fixed.EXECUTABLE_TARGET))
        .select("file", "line", "name", "target")
    )


def _finding(rule: str, evidence: str, rows: DataFrame) -> DataFrame:
    """`rows` (file, line, ...) with a finding id and the rule's."""
    of_line = F.concat(F.lit(f"{evidence}:"), F.col("line").cast("string"))
    return rows.select(finding_id(F.lit(rule), F.lit(""), "file", "line", of_line).alias("id"), F.lit(rule).alias("rule_id"), *rows.columns)


def dynamic_exec_findings(calls: DataFrame) -> DataFrame:
    return _finding("SEC-DYNAMIC-EXEC-001", "dynamic-exec", dynamic_exec(calls))


def executable_write_findings(calls: DataFrame) -> DataFrame:
    written = executable_writes(calls).withColumns({"severity": F.lit("HIGH"), "confidence": F.lit(0.7)})
    return _finding("SEC-SUSPICIOUS-FILE-001", "file-write", written)


def suspicious_files(files: DataFrame) -> DataFrame:
    """Files whose extension has no place in a resource, with how sure that is."""
    # the text after the last dot of the whole path, dot included
    ext = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1))
    pairs = [(e, kind, conf) for kind, conf, exts in fixed.SUSPICIOUS_FILES for e in exts]
    kinds = F.create_map(*[F.lit(x) for e, kind, _ in pairs for x in (e, kind)])
    confs = F.create_map(*[F.lit(x) for e, _, conf in pairs for x in (e, conf)])
    return (
        files.withColumn("extension", ext)
        .withColumn("kind", F.try_element_at(kinds, F.col("extension")))
        .where(F.col("kind").isNotNull())
        .select("path", "kind", "extension", "size_bytes", F.try_element_at(confs, F.col("extension")).alias("confidence"))
    )


def loop_findings(loops: DataFrame) -> DataFrame:
    """Endless loops without a visible yield."""
    rule = F.lit("PERF-LOOP-001")
    return loops.where(F.col("continuous") & ~F.col("yields")).select(
        finding_id(rule, "resource", "file", "line", F.concat(F.lit("loop-"), F.col("line").cast("string"))).alias("id"),
        rule.alias("rule_id"),
        "file",
        "line",
        "kind",
        F.when(F.col("inside_thread"), "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(F.col("unbalanced"), 0.5).when(F.col("opaque_calls") > 0, 0.75).otherwise(0.9).alias("confidence"),
    )


def hot_events(events: DataFrame, loops: DataFrame) -> DataFrame:
    """Network events triggered from a loop that runs every frame or faster.

    `events.loop_line` names the enclosing loop's line in the same file.
    """
    l = loops.select(
        F.col("file").alias("_f"), F.col("line").alias("_l"), "continuous", "yields", "wait_ms"
    )
    e = events.where((F.col("kind") == "TRIGGER") & (F.coalesce("direction", F.lit("")) != "local"))
    hot = F.col("continuous") & (~F.col("yields") | F.coalesce(F.col("wait_ms") < FRAME_MS, F.lit(False)))
    return (
        e.join(l, (F.col("file") == F.col("_f")) & (F.col("loop_line") == F.col("_l")))
        .where(hot)
        .select(
            "id", "event", "file", "line", "loop_line", "wait_ms",
            F.lit("MEDIUM").alias("severity"),
            F.when(F.col("wait_ms").isNull(), 0.7).otherwise(0.85).alias("confidence"),
        )
    )


def is_database_call(name: str = "name") -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).startswith(p) for p in fixed.DATABASE_PREFIXES])


def query_findings(queries: DataFrame) -> DataFrame:
    """Queries in loops, unbounded SELECTs, and SELECT * of a bounded one."""
    sql = F.coalesce("sql", F.lit(""))
    select = sql.rlike(r"(?i)^\s*select\b")
    unbounded = select & ~sql.rlike(r"(?i)\bwhere\b") & ~sql.rlike(r"(?i)\blimit\b")
    star = sql.rlike(r"(?i)\bselect\s+\*")

    def hit(check: str, severity: Column, confidence: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), severity.alias("severity"), confidence.alias("confidence"))

    bounded = F.col("loop_kind") == "FOR"
    issues = F.array_compact(
        F.array(
            F.when(
                F.col("loop_kind").isNotNull(),
                hit("query-loop", F.when(bounded, "MEDIUM").otherwise("HIGH"), F.when(bounded, 0.8).otherwise(0.85)),
            ),
            F.when(unbounded, hit("query-unbounded", F.lit("LOW"), F.lit(0.6))),
            F.when(star & ~unbounded, hit("query-star", F.lit("INFO"), F.lit(0.5))),
        )
    )
    return queries.where(is_database_call("call")).select("file", "line", "call", F.explode(issues).alias("i")).select(
        "file", "line", "call", "i.check", "i.severity", "i.confidence"
    )


def enclosing(positions: DataFrame, loops: DataFrame, width: int = 64) -> DataFrame:
    """Each position with the innermost `[start, end)` interval around it, or NULL.

    `positions`: file, id, at; `loops`: file, start, end; places are whole numbers. The answer
    changes only where an interval starts or ends. So it is sought at those places and at the
    start of every stretch of `width` that holds positions, and each holds up to the
    next one of its stretch, `width` at most. A position then meets its stretch in one row.
    """
    block = lambda at: F.floor(F.col(at) / F.lit(width)).cast("bigint")
    stretches = positions.where("file is not null and at is not null").select("file", block("at").alias("_b")).distinct()
    spans = loops.where("end > start").join(stretches.select("file").distinct(), "file", "left_semi")
    ends = spans.select("file", F.explode(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint"))).alias("_lo")).distinct()
    places = (
        ends.withColumn("_b", block("_lo"))
        .join(stretches, ["file", "_b"], "left_semi")
        .unionByName(stretches.withColumn("_lo", F.col("_b") * F.lit(width)))
        .select("file", "_lo")
        .distinct()
    )
    hits = interval_join(
        places, spans.select("file", F.col("start").alias("loop_start"), F.col("end").alias("loop_end")),
        ["file"], F.col("_lo"), F.col("loop_start"), F.col("loop_end"), width,
    )
    answers = (
        hits.select("file", "_lo", "loop_start")
        .unionByName(places, allowMissingColumns=True)
        .groupBy("file", "_lo")
        .agg(F.max("loop_start").alias("loop_start"))
        .withColumn("_b", block("_lo"))
    )
    after = F.lead("_lo").over(Window.partitionBy("file", "_b").orderBy("_lo"))
    pieces = answers.withColumn("_hi", F.coalesce(after, (F.col("_b") + 1) * F.lit(width))).where("loop_start is not null")
    p = positions.withColumn("_b", block("at"))
    inside = (p["at"] >= pieces["_lo"]) & (p["at"] < pieces["_hi"])
    found = p.join(pieces, (p["file"] == pieces["file"]) & (p["_b"] == pieces["_b"]) & inside, "left")
    return found.select(*[p[c] for c in positions.columns], pieces["loop_start"])
