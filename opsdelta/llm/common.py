"""What several of the operators need from Spark."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, staging_path

#: Bits of a filter over hashed keys: 2 MB, however many keys there are.
FILTER_BITS = 1 << 24


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names: `narrow(df, doc_id=id_col)`. Others cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in columns.items()])


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, the way Spark distributes code."""
    context = spark.sparkContext
    if getattr(context, "_opsdelta_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), "opsdelta.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for base, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(base, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)  # the driver serves it to every executor
    context._opsdelta_shipped = True


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim is not None:
        trim(0)


def _then_give_back(fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def in_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """`mapInArrow` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_then_give_back(fn), schema)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` less the rows whose id is in `dropped`.

    A filter of fixed size settles most rows in place; only those it cannot settle
    are shuffled to be compared with the ids themselves. A null id is never dropped.
    """
    ids = dropped.select(F.col(id_col).alias("dropped_id")).distinct()
    marked = filtered(docs, F.col(id_col), key_filter(ids, F.col("dropped_id")))
    kept = marked.where(~F.col("passes"))
    unsure = marked.where("passes").join(ids, F.col(id_col) == F.col("dropped_id"), "left_anti")
    return kept.unionByName(unsure).select(docs.columns)


def staged(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write to the shared folder and read back: survives lost executors, computed once."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_filter(df: DataFrame, key: Column) -> DataFrame:
    """A bit per hashed key of `df`, as at most FILTER_BITS / 32768 rows of 4 KB (filter_bucket, filter_bits)."""
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    return df.groupBy(F.bitmap_bucket_number(spot).alias("filter_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("filter_bits"))


def filtered(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """`df` with `passes`: false only if the key is not among those of `keys` (a `key_filter`).

    The filter's size is fixed, so it may be broadcast whatever the input is.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    position = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(F.col("filter_bits"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("filter_bucket", F.bitmap_bucket_number(spot))
        .join(F.broadcast(keys), "filter_bucket", "left")
        .withColumn("passes", F.coalesce(F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False)))
        .drop("filter_bucket", "filter_bits")
    )


def hash_bits(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A boolean per value of the low bits of a long column, on the driver: `bits` / 8 bytes at most travel."""
    spot = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = (
        df.groupBy(F.bitmap_bucket_number(spot).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
        .collect()
    )
    out = np.zeros(max(bits, 32768) // 8, dtype=np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)[: len(out) - at]
    return out


def has_bit(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (as uint64) are in a `hash_bits` filter; it may say yes too often, never no."""
    spot = hashes & np.uint64(len(packed) * 8 - 1)
    return (packed[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
