"""Checks over configuration lines, manifests and declared files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import MASK_LONG, finding_id, fixed, glob_to_regex, is_glob, lines, mask_secret
from .text import SENSITIVE_KEY_ONLY, secret_shaped


def config_directives(texts: DataFrame) -> DataFrame:
    """One row per configuration command of every line of every text.

    `texts` is (file, text). A line is cut into words; quotes group words and
    `#` or `//` outside quotes starts a comment.
    """
    word = r"""(?:"[^"\n]*"|'[^'\n]*'|[^\s"'#/]++|/(?!/))+"""
    line = F.col("content")
    head = F.regexp_extract(line, rf"^\s*((?:{word}\s*)*)", 1)
    words = F.transform(F.regexp_extract_all(head, F.lit(f"({word})")), lambda w: F.regexp_replace(w, "[\"']", ""))
    command = F.lower(F.try_element_at("words", F.lit(1)))
    target = F.try_element_at("words", F.lit(2))
    kind = (
        F.when(command.isin(fixed.RESOURCE_COMMANDS), "DIRECTIVE")
        .when(command.isin(fixed.VARIABLE_COMMANDS), "VARIABLE")
        .when(command == "exec", "EXEC")
    )
    return (
        texts.select("file", F.posexplode(lines("text")).alias("pos", "content"))
        .withColumn("words", words)
        .where(kind.isNotNull() & target.isNotNull())
        .select(
            "file",
            (F.col("pos") + 1).cast("bigint").alias("line"),
            kind.alias("kind"),
            command.alias("command"),
            target.alias("target"),
            F.when(kind == "DIRECTIVE", is_category(target)).alias("is_category"),
            F.when(kind == "VARIABLE", F.array_join(F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))), " ")).alias("value"),
        )
    )


def is_category(target: Column) -> Column:
    return target.startswith("[") & target.endswith("]")


def started_resources(directives: DataFrame) -> DataFrame:
    """Targets whose last directive is not a stop; categories do not count."""
    return (
        directives.where(~is_category(F.col("target")))
        .groupBy("server_id", "target")
        .agg(F.max_by("command", "line").alias("command"))
        .where(F.col("command") != "stop")
        .select("server_id", "target")
    )


def ensure_missing(directives: DataFrame, resources: DataFrame, provided: DataFrame) -> DataFrame:
    """Started targets that exist neither as resource nor as alias, once each."""
    names = resources.select(F.col("resource").alias("target")).unionByName(
        provided.select(F.col("alias").alias("target"))
    )
    first = (
        directives.where((F.col("command") != "stop") & ~is_category(F.col("target")))
        .groupBy("server_id", "target")
        .agg(F.min("line").alias("line"), F.min_by("command", "line").alias("command"))
        .join(names.distinct(), "target", "left_anti")
    )
    bundled = F.lower(F.col("target")).isin(fixed.BUNDLED_RESOURCES)
    rule = F.lit("CFG-ENSURE-MISSING-001")
    return first.select(
        finding_id(rule, F.lit(""), F.lit("server.cfg"), "line", "target").alias("id"),
        rule.alias("rule_id"),
        "server_id",
        "target",
        "command",
        "line",
        F.when(bundled, "INFO").otherwise("HIGH").alias("severity"),
        F.when(bundled, 0.2).otherwise(0.9).alias("confidence"),
    )


def manifest_checks(manifests: DataFrame) -> DataFrame:
    """One row per broken manifest rule.

    `manifests`: resource, kind ('none', 'fxmanifest' or '__resource'),
    readable, syntax_lines array<bigint>, fx_version, games array<string>.
    A missing, unreadable or unparsable manifest ends the checks there.
    """
    none = F.col("kind") == "none"
    unreadable = ~none & ~F.col("readable")
    broken = ~none & F.col("readable") & (F.size("syntax_lines") > 0)
    good = ~none & F.col("readable") & (F.size("syntax_lines") == 0)
    modern = F.col("kind") == "fxmanifest"

    def hit(check: str, severity: str, confidence: float, detail: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(severity).alias("severity"),
            F.lit(confidence).alias("confidence"), detail.alias("detail"),
        )

    def one(cond: Column, row: Column) -> Column:
        return F.when(cond, F.array(row))

    version, games = F.col("fx_version"), F.col("games")
    odd = F.filter(games, lambda g: ~g.isin(fixed.KNOWN_GAMES))
    parts = [
        one(none, hit("no-manifest", "HIGH", 0.85)),
        one(unreadable, hit("unreadable", "MEDIUM", 0.9)),
        F.when(broken, F.transform("syntax_lines", lambda n: hit("syntax", "HIGH", 0.95, n.cast("string")))),
        one(good & modern & version.isNull(), hit("missing-fx-version", "MEDIUM", 0.9)),
        one(good & version.isNotNull() & ~version.isin(fixed.KNOWN_FX_VERSIONS), hit("unknown-fx-version", "LOW", 0.5, version)),
        one(good & modern & (F.size(games) == 0), hit("missing-game", "LOW", 0.8)),
        F.when(good, F.transform(odd, lambda g: hit("unknown-game", "LOW", 0.5, g))),
        one(good & (F.col("kind") == "__resource"), hit("legacy-manifest", "INFO", 0.95)),
    ]
    empty = F.slice(F.array(hit("", "", 0.0)), 1, 0)
    issues = reduce(lambda a, b: F.concat(a, F.coalesce(b, empty)), parts, empty)
    return manifests.select("resource", F.explode(issues).alias("i")).select(
        "resource", F.lit("CFG-MANIFEST-001").alias("rule_id"), "i.check", "i.severity", "i.confidence", "i.detail"
    )


def glob_matches(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(declared columns, path) for every file a declared pattern matches.

    Exact patterns are an equi-join. A wildcard pattern meets only files of its
    resource under its literal first directory, and the pattern side is small:
    a manifest's wildcard patterns are written by hand.
    """
    wild = is_glob("pattern")
    clean = declared.withColumn("_p", F.regexp_replace("pattern", r"\\", "/"))
    names = files.select("resource", "path")
    exact = clean.where(~wild).join(names, (clean["resource"] == names["resource"]) & (F.col("_p") == F.col("path"))).select(
        *[clean[c] for c in declared.columns], "path"
    )
    anchor = F.regexp_extract("_p", r"^([^/*?]+)/", 1)
    globs = (
        clean.where(wild).withColumn("_anchor", anchor).withColumn("_re", glob_to_regex("_p")).withColumnRenamed("resource", "_res")
    )
    rooted = names.withColumn(
        "_anchor", F.explode(F.array_distinct(F.array(F.lit(""), F.regexp_extract("path", r"^([^/]+)/", 1))))
    )
    hits = globs.join(
        rooted, (F.col("_res") == rooted["resource"]) & (globs["_anchor"] == rooted["_anchor"]) & F.expr("path rlike _re")
    ).select(*[c for c in declared.columns if c != "resource"], rooted["resource"], "path")
    return exact.unionByName(hits)


def missing_files(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Declared patterns of the resource itself that match none of its files."""
    own = declared.where(F.col("external_resource").isNull())
    keys = ["resource", "directive", "pattern", "line"]
    found = glob_matches(own, files).select(*keys).distinct()
    rule = F.lit("CFG-MISSING-FILE-001")
    wild = is_glob("pattern")
    return own.join(found, keys, "left_anti").select(
        finding_id(rule, "resource", F.lit("manifest"), "line", F.concat("directive", F.lit(":"), "pattern")).alias("id"),
        rule.alias("rule_id"),
        *keys,
        F.when(wild, "MEDIUM").otherwise("HIGH").alias("severity"),
        F.when(wild, 0.6).otherwise(0.95).alias("confidence"),
    )


def script_sides(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """Where each file runs: its only side, 'shared' for several, else 'unknown'."""
    own = scripts.where(F.col("external_resource").isNull())
    sides = (
        glob_matches(own, files)
        .groupBy("resource", "path")
        .agg(F.min("side").alias("_lo"), F.max("side").alias("_hi"))
        .select("resource", "path", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("shared").alias("_side"))
    )
    return files.select("resource", "path").join(sides, ["resource", "path"], "left").select(
        "resource", "path", F.coalesce("_side", F.lit("unknown")).alias("side")
    )


def redact_variables(variables: DataFrame) -> DataFrame:
    """Hide values with a sensitive key or a secret's shape; shorten long ones."""
    v = F.col("value")
    text = F.concat(F.col("target"), F.lit(' = "'), v, F.lit('"'))
    shown = (
        F.when(v == "", v)
        .when(F.col("target").rlike(SENSITIVE_KEY_ONLY) | secret_shaped(v) | secret_shaped(text), F.lit("(redacted)"))
        .when((F.length(v) > MASK_LONG) & (F.instr(v, " ") == 0), mask_secret(v, 6))
        .otherwise(v)
    )
    return variables.withColumn("value", shown)
