"""Streaming forms: ingest, dedupe, windows, correlation, sessions, states.

Every function takes and returns a streaming DataFrame, or starts a query that
writes to a table; none collects to the driver. Times must be `timestamp`; a
stream of zone-less times is cast first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite
from ..operators.incidents import SIDE, link_confidence, signal_role
from ..operators.ordered import with_previous
from ..operators.stats import variation
from ..session import cut_lineage, staging_path
from ..sources.telemetry import import_documents, ledger_rows, stored_events, stored_samples


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, with the schema of the table itself.

    A file is known by its path: land new data under new names.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def read_files_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


def run_to_table(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is available, write it as a Parquet table, and read that."""
    spark = stream.sparkSession
    path = path or staging_path(spark, f"{name}-out")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or staging_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest_stream(raw: DataFrame, ledger_path: str, checkpoint: str, trigger: dict | None = None, samples_path: str | None = None, events_path: str | None = None):
    """Telemetry files into samples, events and the ledger, each content once.

    `raw` streams (file, server_id, json). A batch is checked against the
    ledger and written under its own batch number, so replaying a batch after a
    failure rewrites the same partitions instead of importing twice. The ledger
    is written last: what it names has been stored.
    """
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _ledger(spark, ledger_path, number)
        new = cut_lineage(import_documents(batch, known).where("status = 'IMPORTED'"))
        for path, rows in ((samples_path, stored_samples), (events_path, stored_events)):
            if path is not None:
                rows(new).write.mode("overwrite").parquet(f"{path}/batch={number}")
        ledger_rows(new, F.current_timestamp()).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return (
        raw.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _ledger(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(server_id, digest, raw_digest) of the batches before `number`."""
    schema = "server_id string, digest string, raw_digest string, batch int"
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < number)


def dedupe(docs: DataFrame, time: str, delay: str) -> DataFrame:
    """At most one document per (server, digest) among those within `delay`."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["server_id", "digest"])


def window_stats(samples: DataFrame, by: list[str], window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Sample statistics per time window; rows later than `delay` are dropped
    and counted in the query's progress."""
    v = F.when(finite("value"), F.col("value"))
    return (
        samples.withWatermark("sampled_at", delay)
        .groupBy(F.window("sampled_at", window, slide), *by)
        .agg(
            F.count(v).alias("sample_count"),
            F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
            F.coalesce(F.percentile(v, F.lit(0.5)), F.lit(0.0)).alias("median"),
            F.coalesce(F.percentile(v, F.lit(0.95)), F.lit(0.0)).alias("p95"),
            F.coalesce(F.min(v), F.lit(0.0)).alias("min"),
            F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
            F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("standard_deviation"),
        )
        .withColumn("coefficient_of_variation", variation(F.col("standard_deviation"), F.col("mean")))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
                "sample_count", "mean", "median", "p95", "min", "max", "standard_deviation", "coefficient_of_variation")
    )


def correlate_stream(signals: DataFrame, window_ms: int, delay: str) -> DataFrame:
    """Changes joined with effects as a stream-stream join.

    Both sides are watermarked and the time condition bounds the state kept.
    """
    # one second wider than the rule, which counts whole milliseconds
    seconds = window_ms // 1000 + 1
    side = lambda role: (
        signals.withWatermark("occurred_at", delay)
        .where(signal_role() == role)
        .select(F.col("server_id").alias(f"{role.lower()}_server_id"), *[F.col(c).alias(f"{role.lower()}_{c}") for c in SIDE])
    )
    near = (
        (F.col("change_server_id") == F.col("effect_server_id"))
        & (F.col("effect_occurred_at") >= F.col("change_occurred_at") - F.expr(f"interval {seconds} seconds"))
        & (F.col("effect_occurred_at") <= F.col("change_occurred_at") + F.expr(f"interval {seconds} seconds"))
    )
    return (
        side("CHANGE")
        .join(side("EFFECT"), near)
        .withColumn("delta_ms", F.unix_millis("effect_occurred_at") - F.unix_millis("change_occurred_at"))
        .where(F.abs("delta_ms") <= window_ms)
        .withColumn("confidence", link_confidence(window_ms))
    )


def session_stream(signals: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions per server once the watermark has closed them."""
    s = F.session_window("occurred_at", gap)
    return (
        signals.withWatermark("occurred_at", delay)
        .groupBy("server_id", s.alias("session"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.max("occurred_at").alias("last_at"))
        .select("server_id", F.col("session.start").alias("started_at"), "last_at", "event_count")
    )


STATE_COLUMNS = "id bigint, resource string, observed_at timestamp, state string"


def state_change_stream(observations: DataFrame, out_path: str, state_path: str, checkpoint: str, trigger: dict | None = None):
    """First state per resource, then only observations that differ.

    The last state of every resource is a table with one version per batch.
    A batch puts those rows before its own and runs the batch operator, which
    spreads a busy resource over its time chunks; a replayed batch reads the
    version before it and rewrites its own.
    """
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _version(spark, state_path, number - 1)
        # a known state keeps its time: a late row comes before it and never replaces it
        rows = batch.where("state is not null").select("id", "resource", "observed_at", "state").withColumn("_known", F.lit(False)).unionByName(known.withColumn("_known", F.lit(True)))
        seen = with_previous(rows, ["resource"], "observed_at", "id", ["state"])
        changed = seen.where(~F.col("_known") & (F.col("prev_state").isNull() | (F.col("state") != F.col("prev_state")))).select(
            "id", "resource", "observed_at", "state",
            F.when(F.col("prev_state").isNull(), "resource_state").otherwise("resource_state_changed").alias("kind"),
        )
        changed.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        last = rows.groupBy("resource").agg(
            F.max_by(F.struct("id", "observed_at", "state"), F.struct("observed_at", "id")).alias("l")
        )
        last.select("l.id", "resource", "l.observed_at", "l.state").write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return (
        observations.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _version(spark: SparkSession, path: str, number: int) -> DataFrame:
    if number < 0:
        return spark.createDataFrame([], STATE_COLUMNS)
    return spark.read.schema(STATE_COLUMNS).parquet(f"{path}/batch={number}")
