"""File inventories and the report sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify_file

# The most that a value of Spark's binary type, and so of `binaryFile`, can hold.
HASH_LIMIT = (1 << 31) - 1


def file_inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """One row per file: path, size, hash, time and type.

    The content is only read where it can be hashed; a file over the limit
    keeps its row and says why its hash is missing.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    # the length filters reach the source, so oversized content is never read
    hashed = files.where(F.col("length") <= HASH_LIMIT).select(
        "path", "length", "modificationTime", F.sha2("content", 256).alias("hash"), F.lit(None).cast("string").alias("limitation")
    )
    listed = files.where(F.col("length") > HASH_LIMIT).select(
        "path", "length", "modificationTime", F.lit(None).cast("string").alias("hash"), F.lit("too large to hash").alias("limitation")
    )
    return hashed.unionByName(listed).select(
        "path",
        F.col("length").alias("size_bytes"),
        "hash",
        F.col("modificationTime").alias("modified_at"),
        classify_file("path").alias("file_type"),
        "limitation",
    )


def content_inventory(contents: DataFrame, roots: list[str]) -> DataFrame:
    """The inventory of a table of files (path, content, modified_at), a row each.

    `content` is text or binary of any size a cell may have; it is hashed where it
    is read and never travels. Files outside every root have no resource.
    """
    content = F.col("content").cast("binary")
    return contents.select(
        "path",
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.sha2(content, 256).alias("hash"),
        "modified_at",
        classify_file("path").alias("file_type"),
        assign_resource("path", roots).alias("_r"),
    ).select("path", "size_bytes", "hash", "modified_at", "file_type", "_r.resource", "_r.category")


def assign_resource(path: str | Column, roots: list[str]) -> Column:
    """Struct (resource, directory, category) of a path, NULL for loose files.

    The first matching root counts. A first segment in brackets is a category
    and the second one then names the resource.
    """
    p = F.col(path) if isinstance(path, str) else path

    def under(root: str) -> Column:
        parts = F.split(F.substr(p, F.lit(len(root) + 2)), "/")
        first, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
        category = first.startswith("[") & first.endswith("]")
        at = lambda *names: F.concat_ws("/", F.lit(root), *names)
        plain = F.struct(first.alias("resource"), at(first).alias("directory"), F.lit(None).cast("string").alias("category"))
        nested = F.struct(second.alias("resource"), at(first, second).alias("directory"), first.alias("category"))
        return F.when(category & (F.size(parts) >= 3), nested).when(~category & (F.size(parts) >= 2), plain)

    out = F.when(p.startswith(f"{roots[0]}/"), under(roots[0]))
    for root in roots[1:]:
        out = out.when(p.startswith(f"{root}/"), under(root))
    return out


# Key order of a report document.
REPORT_KEYS = [
    "schemaVersion", "generatedAt", "metadata", "server", "health", "resources", "findings", "dependencies",
    "events", "performance", "security", "integrity", "incidents", "limitations",
]


def report_sections(parts: dict[str, DataFrame]) -> DataFrame:
    """A report as JSON lines (section, position in key order, json).

    One line per row keeps the report a distributed table; sections that were
    not produced are absent rather than empty.
    """
    frames = [
        df.select(
            F.lit(REPORT_KEYS.index(key)).cast("bigint").alias("section_order"),
            F.lit(key).alias("section"),
            F.to_json(F.struct(*df.columns)).alias("json"),
        )
        for key, df in parts.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_report(sections: DataFrame, path: str) -> None:
    sections.write.mode("overwrite").partitionBy("section").json(path)
