"""File snapshots: headers, differences and change findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compact, deterministic_id, finding_id, set_digest

ROOT = "(server root)"


def snapshot_header(entries: DataFrame, server: str, label: str) -> DataFrame:
    """Counts, bytes and one hash over path, size and content (times excluded)."""
    part = F.concat_ws(":", "path", F.col("size_bytes").cast("string"), "hash")
    return entries.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        set_digest(part).alias("snapshot_hash"),
    ).select(
        deterministic_id("snap", F.lit(server), F.lit(label)).alias("id"),
        F.lit(server).alias("server_id"),
        F.lit(label).alias("label"),
        "file_count",
        "total_bytes",
        "snapshot_hash",
    )


def diff_snapshots(before: DataFrame, after: DataFrame, keep_unchanged: bool = False) -> DataFrame:
    """One row per changed path: ADDED, DELETED, MODIFIED or TOUCHED.

    MODIFIED means other content; the same content with another time is only
    TOUCHED. One full outer join on the path.
    """
    attrs = ["resource", "size_bytes", "hash", "modified_at"]
    b = before.select("path", F.struct(*attrs).alias("b"))
    a = after.select("path", F.struct(*attrs).alias("a"))
    kind = (
        F.when(F.col("b").isNull(), "ADDED")
        .when(F.col("a").isNull(), "DELETED")
        .when(~F.col("b.hash").eqNullSafe(F.col("a.hash")), "MODIFIED")
        .when(~F.col("b.modified_at").eqNullSafe(F.col("a.modified_at")), "TOUCHED")
        .otherwise("UNCHANGED")
    )
    joined = (
        b.join(a, "path", "full_outer")
        .withColumn("kind", kind)
        .withColumn("resource", F.when(F.col("a").isNotNull(), F.col("a.resource")).otherwise(F.col("b.resource")))
        .withColumn("details", _details())
        .select(
            "path",
            "kind",
            "resource",
            "details",
            F.substring("b.hash", 1, 16).alias("before_hash"),
            F.substring("a.hash", 1, 16).alias("after_hash"),
        )
    )
    return joined if keep_unchanged else joined.where(F.col("kind") != "UNCHANGED")


def _details() -> Column:
    size = lambda side: F.col(f"{side}.size_bytes").cast("string")
    return (
        F.when(F.col("kind") == "ADDED", F.array(F.concat(F.lit("new file of "), size("a"), F.lit(" bytes"))))
        .when(F.col("kind") == "DELETED", F.array(F.lit("only in the earlier snapshot")))
        .when(
            F.col("kind") == "MODIFIED",
            compact(
                F.concat(
                    F.lit("hash "), F.substring("b.hash", 1, 12), F.lit(" -> "), F.substring("a.hash", 1, 12)
                ),
                F.when(
                    F.col("b.size_bytes") != F.col("a.size_bytes"),
                    F.concat(F.lit("bytes "), size("b"), F.lit(" -> "), size("a")),
                ),
            ),
        )
        .when(F.col("kind") == "TOUCHED", F.array(F.lit("time differs, content is identical")))
    )


def diff_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per kind and whether the snapshots hold the same content."""
    counts = diff_snapshots(before, after, keep_unchanged=True).agg(
        *[
            F.count_if(F.col("kind") == kind).alias(f"{kind.lower()}_count")
            for kind in ("ADDED", "DELETED", "MODIFIED", "TOUCHED", "UNCHANGED")
        ]
    )
    # Equal content means equal snapshot hashes: nothing added, deleted or modified.
    return counts.withColumn(
        "identical", (F.col("added_count") + F.col("deleted_count") + F.col("modified_count")) == 0
    )


def content_changes(diff: DataFrame) -> DataFrame:
    """Changes that count: a touched file is no change."""
    return diff.where(F.col("kind").isin("ADDED", "DELETED", "MODIFIED")).withColumn(
        "owner", F.coalesce("resource", F.lit(ROOT))
    )


def changes_by_resource(diff: DataFrame, before_label: str, after_label: str) -> DataFrame:
    """One INFO finding per resource with changed files."""
    counted = content_changes(diff).groupBy("owner").agg(
        F.count_if(F.col("kind") == "ADDED").alias("added"),
        F.count_if(F.col("kind") == "MODIFIED").alias("modified"),
        F.count_if(F.col("kind") == "DELETED").alias("deleted"),
    )
    resource = F.when(F.col("owner") != ROOT, F.col("owner"))
    return counted.select(
        finding_id(
            F.lit("INT-CHANGE-001"), resource, F.lit(""), F.lit(None).cast("string"),
            F.concat(F.lit(f"{before_label}->{after_label}:"), F.col("owner")),
        ).alias("id"),
        F.lit("INT-CHANGE-001").alias("rule_id"),
        F.lit("INFO").alias("severity"),
        F.lit(1.0).alias("confidence"),
        resource.alias("resource"),
        F.concat(
            F.col("owner"), F.lit(": "), F.col("added").cast("string"), F.lit(" added, "),
            F.col("modified").cast("string"), F.lit(" modified, "), F.col("deleted").cast("string"), F.lit(" deleted"),
        ).alias("summary"),
        "added",
        "modified",
        "deleted",
    )


def change_evidence(diff: DataFrame, limit: int = 25) -> DataFrame:
    """The first `limit` changes per resource: added, deleted, then modified.

    The row_number filter becomes a group limit that trims every task's rows
    before the shuffle, so a resource that holds most changes stays cheap.
    """
    rank = F.when(F.col("kind") == "ADDED", 0).when(F.col("kind") == "DELETED", 1).otherwise(2)
    w = Window.partitionBy("owner").orderBy(rank, "path")
    return (
        content_changes(diff)
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= limit)
        .select("owner", F.col("position").cast("bigint").alias("position"), "kind", "path", "before_hash", "after_hash")
    )


def find_snapshot(snapshots: DataFrame, name: str) -> DataFrame:
    """The snapshot with that id, or the newest one with that label."""
    found = snapshots.where((F.col("id") == name) | (F.col("label") == name))
    exact = (F.col("id") == name).cast("int")
    newest = found.agg(F.max_by(F.struct(*snapshots.columns), F.struct(exact, "created_at", "id")).alias("s"))
    return newest.where("s is not null").select("s.*")


def delete_snapshot(child: DataFrame, removed: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """The rows of a child table that remain once the `removed` snapshots are gone."""
    return child.join(removed.select(F.col("id").alias(key)), key, "left_anti")


def list_snapshots(snapshots: DataFrame, limit: int = 20) -> DataFrame:
    return snapshots.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)
