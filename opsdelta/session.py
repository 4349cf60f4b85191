"""Session settings the operators rely on, and the lineage-cutting helper."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "opsdelta", master: str | None = None, **confs: str) -> SparkSession:
    """A session with the settings above; `confs` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in confs.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; every timestamp rule here is stated in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


ADVISORY, PART_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"


def small_parts(spark: SparkSession) -> SparkSession:
    """Let adaptive execution merge shuffle partitions up to 8 MB only, unless the session says otherwise.

    Its default of 64 MB counts compressed bytes. Rows of ids, names and times take some ten
    times that once a task sorts them, and a task sorts two sides and groups what it joins.
    """
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, PART_BYTES)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in `spark.checkpoint.dir`. Only a local session may
    fall back to a temporary folder: elsewhere the executors could not share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-opsdelta-")
        spark.conf.set("spark.checkpoint.dir", shared)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Like a reliable checkpoint it survives the loss of executors. Unlike
    `checkpoint()` it also drops the plan's inferred constraints, which grow
    from round to round of an iterative job until planning takes minutes.
    """
    return cut_and_count(df)[0]


def cut_and_count(df: DataFrame, where: Column | None = None, path: str | None = None) -> tuple[DataFrame, int]:
    """`cut_lineage` that also counts rows (those matching `where`) as it writes."""
    path = path or staging_path(df.sparkSession, "round")
    seen = Observation()
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    df.observe(seen, counted.alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def spread(df: DataFrame) -> DataFrame:
    """More tasks where a scan has fewer splits than the session has cores.

    A file with one row group is one split, so heavy per-row work on it would
    run in one task. Large tables have splits enough and pass through as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
