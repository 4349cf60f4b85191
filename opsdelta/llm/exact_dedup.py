"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when their bytes are; a null counts as empty. Of equal texts the
row with the largest id stays. Each round only looks at what the round before
could not tell apart, and passes its surviving keys on as a filter of fixed size,
so texts never travel and a group of any size costs what its rows cost: groups are
counted by combinable aggregates, and the result is joined back on the full hash.

Repeated rows: rows that repeat both id and text are equal texts like any other;
all of them carry the same `keep_id` and are `kept` only if their id is it, so a
repeated winner stays repeated. A null id counts as smaller than any other.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filtered, key_filter, narrow, staged

#: Characters that the second round hashes.
PREFIX = 64


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    `text_sha256` is null where length or prefix already prove a text unique and
    its content was not read in full; `digest_all` asks for it everywhere.
    """
    base = narrow(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    length = F.octet_length("text").alias("n_bytes")
    head = F.xxhash64(F.left("text", F.lit(prefix))).alias("head")
    by_length = repeated(base.select(length), "n_bytes")
    same_length = filtered(base.select(length, head), F.col("n_bytes"), by_length).where("passes")
    by_head = repeated(same_length.select("n_bytes", "head"), "n_bytes", "head")
    open_rows = filtered(base.select("doc_id", "text", length, head), F.struct("n_bytes", "head"), by_head)
    full = F.sha2("text", 256)
    hashed = staged(
        open_rows.select("doc_id", "n_bytes", "head", "passes", (full if digest_all else F.when(F.col("passes"), full)).alias("text_sha256")),
        "exact-dedup",
    )
    groups = (
        hashed.where("passes")
        .groupBy("n_bytes", "head", "text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("text_sha256").alias("group_sha256"), "keep_id", "group_size")
    )
    return hashed.join(groups, F.col("passes") & (F.col("text_sha256") == F.col("group_sha256")), "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The filter of the keys that occur more than once."""
    return key_filter(df.groupBy(*keys).count().where("count > 1"), F.struct(*keys) if len(keys) > 1 else F.col(keys[0]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the contract asks for the hash of unique texts too."""
    return exact_dedup(documents(spark, sf_dir), digest_all=True)


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by sha256(coalesce(text, '')))
"""
