"""Health scores in which every deducted point names its finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, js_round
from .findings import dimension, order_key


def health_category(category: str = "category") -> Column:
    """ERRORS count as RELIABILITY; the others keep their name."""
    return F.when(F.col(category) == "ERRORS", "RELIABILITY").otherwise(F.col(category))


def _points() -> Column:
    base = reduce(
        lambda acc, kv: acc.when(F.col("severity") == kv[0], F.lit(kv[1])),
        list(fixed.SEVERITY_POINTS.items())[1:],
        F.when(F.col("severity") == "CRITICAL", F.lit(fixed.SEVERITY_POINTS["CRITICAL"])),
    )
    return js_round(F.coalesce(base, F.lit(0)) * F.col("confidence")).cast("bigint")


def deductions(findings: DataFrame) -> DataFrame:
    """Findings that cost points; those rounding to zero are left out."""
    return (
        findings.withColumn("health_category", health_category())
        .withColumn("points", _points())
        .where(F.col("points") > 0)
    )


def clamp(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), js_round(score))).cast("bigint")


def weights(spark) -> DataFrame:
    return dimension(spark, list(fixed.CATEGORY_WEIGHTS.items()), "health_category string, weight int")


def category_scores(findings: DataFrame, available: list[str], by: list[str] = [], groups: DataFrame | None = None) -> DataFrame:
    """100 minus the points, per available category; an unhurt one scores 100.

    With `by`, `groups` lists the keys to score, so a resource without a single
    finding is scored too. The category side of that product has six rows.
    """
    dims = F.broadcast(weights(findings.sparkSession).where(F.col("health_category").isin(available)))
    spent = deductions(findings).groupBy(*by, "health_category").agg(F.sum("points").alias("spent"))
    base = dims if not by else groups.select(*by).distinct().withColumn(
        "health_category", F.explode(F.array(*[F.lit(c) for c in available]))
    ).join(dims, "health_category")
    return base.join(spent, [*by, "health_category"], "left").select(
        *by,
        "health_category",
        "weight",
        F.coalesce("spent", F.lit(0)).cast("bigint").alias("points"),
        clamp(F.lit(100) - F.coalesce("spent", F.lit(0))).alias("score"),
    )


def caps(findings: DataFrame, by: list[str] = []) -> DataFrame:
    """The finding that caps the score: first CRITICAL, else first HIGH, if any.

    Looks at every finding, also those of categories that are not scored.
    """
    def first(severity: str) -> Column:
        least = fixed.SCORE_CAPS[severity][1]
        hit = (F.col("severity") == severity) & (F.col("confidence") >= least)
        return F.min_by(
            F.when(hit, F.struct(F.col("rule_id"), F.col("id"), F.col("title"))), F.when(hit, order_key())
        )

    grouped = findings.groupBy(*by).agg(first("CRITICAL").alias("c"), first("HIGH").alias("h"))
    hit = F.coalesce("c", "h")
    cap = F.when(F.col("c").isNotNull(), fixed.SCORE_CAPS["CRITICAL"][0]).when(
        F.col("h").isNotNull(), fixed.SCORE_CAPS["HIGH"][0]
    )
    severity = F.when(F.col("c").isNotNull(), "CRITICAL").otherwise("HIGH")
    return grouped.where(hit.isNotNull()).select(
        *by,
        cap.cast("bigint").alias("cap"),
        severity.alias("cap_severity"),
        hit["rule_id"].alias("cap_rule_id"),
        hit["id"].alias("cap_finding_id"),
        hit["title"].alias("cap_title"),
    )


def health_score(findings: DataFrame, available: list[str], by: list[str] = [], groups: DataFrame | None = None) -> DataFrame:
    """Weighted mean over the available categories, then the cap."""
    scored = category_scores(findings, available, by, groups)
    overall = scored.groupBy(*by).agg(
        F.sum(F.col("weight") * F.col("score")).alias("_ws"),
        F.sum("weight").alias("_w"),
        F.sum("points").cast("bigint").alias("points"),
    )
    capped = caps(findings, by)
    joined = overall.join(capped, by, "left") if by else overall.join(F.broadcast(capped), F.lit(True), "left")
    raw = clamp(F.coalesce(F.try_divide(F.col("_ws"), F.col("_w")), F.lit(100.0)))
    return joined.select(
        *by,
        F.least(raw, F.coalesce("cap", F.lit(100))).cast("bigint").alias("score"),
        raw.alias("uncapped_score"),
        F.coalesce("points", F.lit(0)).alias("points"),
        "cap",
        "cap_rule_id",
    )


def primary_reasons(findings: DataFrame, available: list[str], by: list[str] = [], groups: DataFrame | None = None) -> DataFrame:
    """The cap, then the five costliest (severity, rule) pairs, else one fallback.

    The ranking window sees at most one row per severity and rule.
    """
    per_rule = (
        deductions(findings)
        .where(F.col("health_category").isin(available))
        .groupBy(*by, "severity", "rule_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("pts"))
    )
    w = Window.partitionBy(*by).orderBy(F.col("pts").desc(), "severity", "rule_id")
    top = per_rule.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 5)
    text = F.concat(
        "severity", F.lit(": "), F.col("n").cast("string"), F.lit(" "), "rule_id",
        F.when(F.col("n") == 1, F.lit(" finding (-")).otherwise(F.lit(" findings (-")),
        F.col("pts").cast("string"), F.lit(")"),
    )
    cap_text = F.concat(
        F.lit("capped at "), F.col("cap").cast("string"), F.lit(" by "), "cap_severity", F.lit(" "), "cap_rule_id",
        F.lit(": "), "cap_title",
    )
    cap_rows = caps(findings, by).select(*by, F.lit(0).cast("bigint").alias("position"), cap_text.alias("reason"))
    rows = cap_rows.unionByName(top.select(*by, F.col("r").cast("bigint").alias("position"), text.alias("reason")))
    fallback = F.lit("Nothing was deducted: the score is full.")
    if by:
        keys = groups.select(*by).distinct()
        quiet = keys.join(rows.select(*by).distinct(), by, "left_anti")
        return rows.unionByName(quiet.select(*by, F.lit(1).cast("bigint").alias("position"), fallback.alias("reason")))
    some = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    return rows.unionByName(some.select(F.lit(1).cast("bigint").alias("position"), fallback.alias("reason")))


def unavailable(spark, available: list[str], reasons: dict[str, str] | None = None) -> DataFrame:
    """One row per category that was not scored, with the reason."""
    reasons = reasons or {}
    rows = [(c, reasons.get(c, "not analysed")) for c in fixed.CATEGORY_WEIGHTS if c not in available]
    return dimension(spark, rows, "health_category string, reason string")


def worst_resources(per_resource: DataFrame, n: int = 10) -> DataFrame:
    return per_resource.orderBy(F.col("score").asc(), F.col("resource").asc()).limit(n)
