"""Baselines: claiming samples, inventories, headers and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compact, deterministic_id, set_digest
from .joins import disjoint_join

WEEK_US = 7 * 86_400_000_000


def claim_samples(samples: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add `baseline_label`: the first baseline at or after a sample was known.

    A sample is known once it is both taken and imported, so a late import goes
    to the next baseline. This forward as-of join runs on disjoint intervals
    between baselines, cut into weeks, so a row meets at most a few candidates
    and a hot server is spread over its weeks.
    """
    known = F.unix_micros(F.greatest(F.col("sampled_at"), F.coalesce(F.col("imported_at"), F.col("sampled_at"))))
    points = samples.withColumn("_known", known)
    earliest = points.groupBy("server_id").agg(F.min("_known").alias("_min"))
    per_server = Window.partitionBy("server_id").orderBy("created_at")
    spans = (
        # of baselines created at the same time the least label counts
        baselines.groupBy("server_id", "created_at")
        .agg(F.min("label").alias("baseline_label"))
        .withColumn("_from", F.lag("created_at").over(per_server))
        .join(earliest, "server_id")
        .select(
            "server_id",
            "baseline_label",
            # (previous, created_at] in whole microseconds is [previous + 1, created_at + 1)
            F.coalesce(F.unix_micros("_from") + 1, F.col("_min")).alias("_span_lo"),
            (F.unix_micros("created_at") + 1).alias("_span_hi"),
        )
    )
    joined = disjoint_join(
        points, spans, ["server_id"], F.col("_known"), F.col("_span_lo"), F.col("_span_hi"), WEEK_US, "left"
    )
    return joined.drop("_known", "_span_lo", "_span_hi")


def resource_inventory(files: DataFrame, by: list[str] = ["resource"]) -> DataFrame:
    """Per resource: file count, bytes and a content hash that ignores times."""
    part = F.concat_ws(":", "path", F.col("size_bytes").cast("string"), "hash")
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("size_bytes").cast("bigint").alias("total_bytes"),
        set_digest(part).alias("content_hash"),
    )


def server_fingerprint(resources: DataFrame, config_text: DataFrame | None = None) -> DataFrame:
    """One digest over `name:count` of every resource and the config length."""
    parts = resources.select(F.concat_ws(":", "resource", F.col("file_count").cast("string")).alias("part"))
    if config_text is not None:
        length = config_text.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"))
        parts = parts.unionByName(length.select(F.concat(F.lit("config:"), F.col("n").cast("string")).alias("part")))
    return parts.agg(set_digest("part").alias("server_fingerprint"))


def config_fingerprint(text) -> F.Column:
    return F.sha2(text, 256)


def capture_header(
    inventory: DataFrame, findings: DataFrame, claimed: DataFrame, baselines: DataFrame
) -> DataFrame:
    """Baseline headers with the size of what they captured; duplicates dropped.

    `inventory` and `findings` carry `server_id`; `claimed` is the output of
    `claim_samples`. (server, label) is unique: the earliest capture wins.
    """
    unique = baselines.groupBy("server_id", "label").agg(F.min("created_at").alias("created_at"))
    r = inventory.groupBy("server_id").agg(F.count(F.lit(1)).alias("resource_count"))
    f = findings.groupBy("server_id").agg(F.count(F.lit(1)).alias("finding_count"))
    s = (
        claimed.where(F.col("baseline_label").isNotNull())
        .groupBy("server_id", F.col("baseline_label").alias("label"))
        .agg(F.count(F.lit(1)).alias("sample_count"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        unique.join(r, "server_id", "left")
        .join(f, "server_id", "left")
        .join(s, ["server_id", "label"], "left")
        .select(
            deterministic_id("bl", "server_id", "label").alias("id"),
            "server_id",
            "label",
            "created_at",
            F.coalesce("resource_count", zero).alias("resource_count"),
            F.coalesce("finding_count", zero).alias("finding_count"),
            F.coalesce("sample_count", zero).alias("sample_count"),
        )
    )


def diff_resources(before: DataFrame, after: DataFrame, key: str = "resource") -> DataFrame:
    """ADDED, REMOVED, MODIFIED or UNCHANGED per resource, with what differs."""
    attrs = ["content_hash", "file_count", "total_bytes", "version"]
    b = before.select(key, F.struct(*attrs).alias("b"))
    a = after.select(key, F.struct(*attrs).alias("a"))

    def moved(label: str, c: str, absent: str = "none"):
        old = F.coalesce(F.col(f"b.{c}").cast("string"), F.lit(absent))
        new = F.coalesce(F.col(f"a.{c}").cast("string"), F.lit(absent))
        return F.when(
            ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.concat(F.lit(f"{label} "), old, F.lit(" -> "), new)
        )

    details = (
        F.when(F.col("b").isNull(), F.array(F.lit("only in the later one")))
        .when(F.col("a").isNull(), F.array(F.lit("only in the earlier one")))
        .otherwise(
            compact(
                F.when(~F.col("b.content_hash").eqNullSafe(F.col("a.content_hash")), F.lit("contents changed")),
                moved("file count", "file_count"),
                moved("bytes", "total_bytes"),
                moved("version", "version"),
            )
        )
    )
    kind = (
        F.when(F.col("b").isNull(), "ADDED")
        .when(F.col("a").isNull(), "REMOVED")
        .when(F.size("details") > 0, "MODIFIED")
        .otherwise("UNCHANGED")
    )
    return (
        b.join(a, key, "full_outer")
        .withColumn("details", details)
        .select(key, kind.alias("kind"), "details")
    )


def diff_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """INTRODUCED (later only) and RESOLVED (earlier only) findings by id."""
    cols = ["finding_id", "rule_id", "severity", "resource", "title"]
    new = after.select(*cols).join(before.select("finding_id"), "finding_id", "left_anti")
    gone = before.select(*cols).join(after.select("finding_id"), "finding_id", "left_anti")
    return new.withColumn("kind", F.lit("INTRODUCED")).unionByName(gone.withColumn("kind", F.lit("RESOLVED")))


def compare_headers(before: DataFrame, after: DataFrame, key: str = "server_id") -> DataFrame:
    """Was the configuration changed, and by how much did health move.

    `config_changed` needs both fingerprints; `health_delta` is NULL when
    either score is unknown.
    """
    b = before.select(key, F.col("config_fingerprint").alias("bc"), F.col("health_score").alias("bh"))
    a = after.select(key, F.col("config_fingerprint").alias("ac"), F.col("health_score").alias("ah"))
    return b.join(a, key).select(
        key,
        F.coalesce(F.col("bc") != F.col("ac"), F.lit(False)).alias("config_changed"),
        (F.col("ah") - F.col("bh")).alias("health_delta"),
    )


def list_baselines(baselines: DataFrame, server: str | None = None) -> DataFrame:
    """Newest first."""
    scoped = baselines if server is None else baselines.where(F.col("server_id") == server)
    return scoped.orderBy(F.col("created_at").desc(), "server_id", "label")


def find_baseline(baselines: DataFrame, server: str, label: str) -> DataFrame:
    return baselines.where((F.col("server_id") == server) & (F.col("label") == label))


def baseline_details(child: DataFrame, server: str, label: str, by: list[str]) -> DataFrame:
    """The detail rows that a baseline holds in a child table, in the order of `by`.

    Resource names go by name, findings by id. Both conditions reach the scan.
    """
    own = child.where((F.col("server_id") == server) & (F.col("baseline_label") == label))
    return own.orderBy(*by)


def delete_baseline(child: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of a child table that remain once `removed` baselines are gone."""
    gone = removed.select("server_id", F.col("label").alias("baseline_label"))
    return child.join(gone, ["server_id", "baseline_label"], "left_anti")
