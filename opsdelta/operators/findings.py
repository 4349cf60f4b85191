"""Finding tables: order, counts, filters, checks and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compact, fixed, severity_name, severity_rank
from .ordered import ranked


def dimension(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table; its size is the length of the list given."""
    return spark.createDataFrame(rows, schema)


def severities(spark) -> DataFrame:
    return dimension(spark, list(enumerate(fixed.SEVERITIES)), "severity_rank int, severity string")


def catalog(spark) -> DataFrame:
    return dimension(spark, fixed.RULE_CATALOG, "rule_id string, category string, default_severity string")


def order_columns() -> list[Column]:
    """Most severe, most certain, then rule, resource, file, line and id."""
    return [
        severity_rank("severity").desc(),
        F.col("confidence").desc(),
        F.col("rule_id").asc(),
        F.coalesce("resource", F.lit("")).asc(),
        F.coalesce("file", F.lit("")).asc(),
        F.coalesce("line", F.lit(0)).asc(),
        F.col("id").asc(),
    ]


def order_key() -> Column:
    """The same order as one struct, for `min_by`."""
    return F.struct(
        -severity_rank("severity"),
        -F.col("confidence"),
        F.col("rule_id"),
        F.coalesce("resource", F.lit("")),
        F.coalesce("file", F.lit("")),
        F.coalesce(F.col("line").cast("bigint"), F.lit(0)),
        F.col("id"),
    )


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order_columns())


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    return order_findings(findings).limit(n)


def max_severity(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(severity_name(F.max(severity_rank("severity"))).alias("max_severity"))


def at_least(severity: str) -> Column:
    return severity_rank("severity") >= fixed.SEVERITIES.index(severity)


def count_by_severity(findings: DataFrame) -> DataFrame:
    """All five severities, zero where none was found."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (
        severities(findings.sparkSession)
        .join(counts, "severity", "left")
        .select("severity", F.coalesce("n", F.lit(0)).alias("finding_count"))
    )


def finding_summary(findings: DataFrame) -> DataFrame:
    """Counts by category and by rule in one pass over two grouping sets."""
    return findings.groupingSets([["category"], ["rule_id"]], "category", "rule_id").agg(
        F.count(F.lit(1)).alias("finding_count")
    )


def filter_findings(
    findings: DataFrame,
    min_severity: str | None = None,
    category: str | None = None,
    resource: str | None = None,
    disabled: list[str] = (),
) -> DataFrame:
    """Optional filters, all of which must hold."""
    out = findings
    if min_severity is not None:
        out = out.where(at_least(min_severity))
    if category is not None:
        out = out.where(F.col("category") == category.upper())
    if resource is not None:
        out = out.where(F.col("resource") == resource)
    if disabled:
        out = out.where(~F.col("rule_id").isin(list(disabled)))
    return out


def truncated(findings: DataFrame, limit: int) -> DataFrame:
    """The first `limit` findings, each with the total and a note on the rest."""
    total = findings.agg(F.count(F.lit(1)).alias("total"))
    rest = F.col("total") - F.lit(limit)
    note = F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" more findings match and are left out here.")))
    # `total` is one row by construction, so this join only adds two columns.
    return top_findings(findings, limit).join(F.broadcast(total)).withColumn("note", note)


def findings_by_resource(findings: DataFrame) -> DataFrame:
    """(resource, position, id): every resource's findings in finding order."""
    tail = [
        F.col("rule_id").asc(),
        F.coalesce("file", F.lit("")).asc(),
        F.coalesce("line", F.lit(0)).asc(),
        F.col("id").asc(),
    ]
    return ranked(
        findings.where(F.col("resource").isNotNull()),
        ["resource"],
        [(severity_rank("severity"), True), (F.col("confidence"), True)],
        tail,
    ).select("resource", "position", "id")


def fail_gate(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.agg(F.coalesce(F.bool_or(at_least(threshold)), F.lit(False)).alias("failed"))


def validate_findings(findings: DataFrame) -> DataFrame:
    """One row per broken rule of a finding: (id, path, message)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")

    def issue(broken: Column, path: str, message: str) -> Column:
        return F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))

    conf = F.col("confidence")
    issues = compact(
        issue(blank("id"), "id", "no id"),
        issue(blank("rule_id"), "rule_id", "no rule"),
        issue(severity_rank("severity").isNull(), "severity", "unknown severity"),
        issue(conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1), "confidence", "outside 0 to 1"),
        issue(blank("title"), "title", "no title"),
        issue(blank("recommendation"), "recommendation", "no recommendation"),
        issue(
            F.coalesce(F.col("severity") != "INFO", F.lit(True)) & (F.coalesce("evidence_count", F.lit(0)) == 0),
            "evidence",
            "no evidence above INFO",
        ),
        issue(F.col("created_at").isNull(), "created_at", "no timestamp"),
    )
    return findings.select("id", F.explode(issues).alias("i")).select("id", "i.path", "i.message")


def catalog_join(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Category from the rule catalog (16 rows); an unknown rule is marked, not dropped."""
    rules = catalog(findings.sparkSession) if rules is None else rules
    dim = rules.select("rule_id", F.col("category").alias("catalog_category"), "default_severity")
    return findings.join(dim, "rule_id", "left").withColumn("accepted", F.col("catalog_category").isNotNull())


def security_section(findings: DataFrame, ran: bool = True) -> DataFrame | None:
    """Zero-filled severity counts of the SECURITY findings; None when not run."""
    if not ran:
        return None
    return count_by_severity(findings.where(F.col("category") == "SECURITY"))


def resources_overview(resources: DataFrame, dependencies: DataFrame, findings: DataFrame, health: DataFrame) -> DataFrame:
    """Per resource: version, files, declared dependencies, findings and health."""
    deps = dependencies.groupBy("resource").agg(F.count(F.lit(1)).alias("dependency_count"))
    found = findings.groupBy("resource").agg(F.count(F.lit(1)).alias("finding_count"))
    zero = F.lit(0).cast("bigint")
    return (
        resources.join(deps, "resource", "left")
        .join(found, "resource", "left")
        .join(health.select("resource", F.col("score").alias("health_score")), "resource", "left")
        .select(
            "resource",
            "version",
            "file_count",
            F.coalesce("dependency_count", zero).alias("dependency_count"),
            F.coalesce("finding_count", zero).alias("finding_count"),
            "health_score",
        )
    )
