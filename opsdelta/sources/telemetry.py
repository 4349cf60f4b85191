"""Telemetry documents: reading, checking, digests and import-once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint, finite, fixed
from ..operators.keyfilter import key_filter, may_match
from ..session import cut_and_count, cut_lineage

HEADER = (
    "struct<schemaVersion:variant,collector:variant,collectorVersion:variant,writtenAt:variant,serverUptimeMs:variant,"
    "samples:variant,events:variant,dropped:struct<samples:variant,events:variant>>"
)
SAMPLE = "struct<metric:variant,value:variant,unit:variant,playerCount:variant,at:variant>"
EVENT = "struct<kind:variant,resource:variant,detail:variant,playerCount:variant,at:variant>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every `*.json` file under `path` as (file, json), one document per file."""
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))
    )


def _string(v: Column) -> Column:
    """The text of a JSON string; NULL for any other type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    """A JSON number as double; a number in quotes is none."""
    return F.when(F.substring(F.schema_of_variant(v), 1, 3).isin("BIG", "DEC", "DOU", "FLO"), F.try_variant_get(v, "$", "double"))


def _let(value: Column, body) -> Column:
    """One-element array of `body(value)`, with `value` computed once."""
    return F.transform(F.array(value), body)


def _items(v: Column, item: str, fields, keep) -> Column:
    """The array in `v` as structs; elements that fail `keep` are dropped."""
    each = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(F.transform(each, lambda e: F.try_variant_get(e, "$", item)), fields), keep)


def parse(docs: DataFrame) -> DataFrame:
    """Add the checked document or the reason why it is not one.

    Keeps the columns of `docs` but for `json`. Bad samples and events are
    dropped, missing fields stay NULL, and nothing fails the whole read. Each
    text is parsed once: the document leaves a generator as one row, which also
    keeps filters on it from repeating the work below.
    """
    infinite = F.lit(float("inf"))
    sample = lambda x: F.struct(
        _string(x["metric"]).alias("metric"), _number(x["value"]).alias("value"), _string(x["unit"]).alias("unit"),
        _number(x["playerCount"]).alias("player_count"), _number(x["at"]).alias("at"),
    )
    event = lambda x: F.struct(
        _string(x["kind"]).alias("kind"), _string(x["resource"]).alias("resource"), _string(x["detail"]).alias("detail"),
        _number(x["playerCount"]).alias("player_count"), _number(x["at"]).alias("at"),
    )
    good_sample = lambda s: (
        s["metric"].isNotNull() & s["unit"].isNotNull() & (F.abs(s["value"]) < infinite) & (F.abs(s["at"]) < infinite)
    )
    good_event = lambda e: e["kind"].isNotNull() & (F.abs(e["at"]) < infinite)

    def fields(p: Column) -> Column:
        h = p["h"]
        version = _string(h["schemaVersion"])
        reason = (
            F.when(p["shape"].isNull(), F.lit("not valid JSON"))
            .when(p["shape"] != "OBJECT", F.lit("not a JSON object"))
            .when(version.isNull(), F.lit("no schemaVersion"))
            .when(~version.isin(fixed.TELEMETRY_VERSIONS), F.concat(F.lit("unsupported schemaVersion "), version))
        )
        lost_s, lost_e = _number(h["dropped"]["samples"]), _number(h["dropped"]["events"])
        count = lambda mine, other: F.when(other.isNotNull(), F.coalesce(mine, F.lit(0.0))).otherwise(F.lit(0.0)).try_cast("bigint")
        return F.struct(
            reason.alias("reason"),
            version.alias("schema_version"),
            F.coalesce(_string(h["collector"]), F.lit(fixed.DEFAULT_COLLECTOR)).alias("collector"),
            _string(h["collectorVersion"]).alias("collector_version"),
            F.coalesce(_number(h["writtenAt"]), F.lit(0.0)).alias("written_at"),
            F.coalesce(_number(h["serverUptimeMs"]), F.lit(0.0)).alias("uptime_ms"),
            _items(h["samples"], SAMPLE, sample, good_sample).alias("samples"),
            _items(h["events"], EVENT, event, good_event).alias("events"),
            count(lost_s, lost_e).alias("dropped_samples"),
            count(lost_e, lost_s).alias("dropped_events"),
        )

    heads = _let(
        F.try_parse_json("json"),
        lambda v: F.struct(
            F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).alias("shape"), F.try_variant_get(v, "$", HEADER).alias("h")
        ),
    )
    rest = [c for c in docs.columns if c != "json"]
    return docs.select(*rest, F.inline(F.transform(heads, fields)))


def problems(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("file", "reason")


def documents(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def read_telemetry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, problems) of a folder."""
    parsed = parse(read_documents(spark, path))
    return documents(parsed), problems(parsed)


def explode_samples(docs: DataFrame, keep: list[str] = ["file"]) -> DataFrame:
    return docs.select(*keep, F.explode("samples").alias("s")).select(*keep, "s.*")


def explode_events(docs: DataFrame, keep: list[str] = ["file"]) -> DataFrame:
    return docs.select(*keep, F.explode("events").alias("e")).select(*keep, "e.*")


def source_label() -> Column:
    return F.concat(F.col("collector"), F.lit("@"), F.coalesce("collector_version", F.lit("unknown")))


def seconds_to_timestamp(seconds: Column) -> Column:
    """NULL for a number that is no time a timestamp can hold."""
    return F.when(F.abs(seconds) < 9e12, F.timestamp_micros(F.floor(seconds * 1e6 + 0.5).cast("bigint")))


def stored_samples(docs: DataFrame, keep: list[str] = ["server_id"]) -> DataFrame:
    """Sample rows as stored: server scope, UTC time and their source."""
    return explode_samples(docs.withColumn("source", source_label()), [*keep, "source"]).select(
        *keep,
        F.lit(fixed.SERVER_SCOPE).alias("resource"),
        "metric",
        "value",
        "unit",
        F.col("player_count").try_cast("bigint").alias("player_count"),
        seconds_to_timestamp(F.col("at")).alias("sampled_at"),
        "source",
    )


def stored_events(docs: DataFrame, keep: list[str] = ["server_id"]) -> DataFrame:
    return explode_events(docs.withColumn("source", source_label()), [*keep, "source"]).select(
        *keep,
        "kind",
        "resource",
        "detail",
        F.col("player_count").try_cast("bigint").alias("player_count"),
        seconds_to_timestamp(F.col("at")).alias("observed_at"),
        "source",
    )


def summary(docs: DataFrame) -> DataFrame:
    """One row: counts, time range over samples and events, dropped totals.

    Ranges are folded inside each document, so nothing is exploded or shuffled
    but one row per task. No times: NULL, not zero.
    """
    return _summary(docs.agg(*_totals(F.lit(True))))


def _totals(good: Column) -> list[Column]:
    """The aggregates of `summary` over the documents that are `good`."""
    total = lambda c: F.coalesce(F.sum(F.when(good, c)), F.lit(0).cast("bigint"))
    times = lambda f, g: g(f("samples.at"), f("events.at"))
    return [
        F.count_if(good).alias("document_count"),
        total(F.size("samples").cast("bigint")).alias("sample_count"),
        total(F.size("events").cast("bigint")).alias("event_count"),
        F.min(F.when(good, times(F.array_min, F.least))).alias("_lo"),
        F.max(F.when(good, times(F.array_max, F.greatest))).alias("_hi"),
        total(F.col("dropped_samples")).alias("dropped_samples"),
        total(F.col("dropped_events")).alias("dropped_events"),
    ]


def _summary(totals: DataFrame, *more: str) -> DataFrame:
    return totals.select(
        "document_count",
        "sample_count",
        "event_count",
        seconds_to_timestamp(F.col("_lo")).alias("earliest"),
        seconds_to_timestamp(F.col("_hi")).alias("latest"),
        "dropped_samples",
        "dropped_events",
        *more,
    )


def observed_names(docs: DataFrame) -> DataFrame:
    """Distinct metrics and resources, one row each: (role, name)."""
    names = F.concat(
        F.transform("samples", lambda s: F.struct(F.lit("METRIC").alias("role"), s["metric"].alias("name"))),
        F.transform(
            F.filter("events", lambda e: e["resource"].isNotNull()),
            lambda e: F.struct(F.lit("RESOURCE").alias("role"), e["resource"].alias("name")),
        ),
    )
    return docs.select(F.explode(F.array_distinct(names)).alias("n")).select("n.role", "n.name").distinct()


def _digits(x: Column) -> Column:
    """Six decimals; a number too large for that in its own text."""
    return F.coalesce(x.try_cast("decimal(38,6)").cast("string"), x.cast("string"))


def with_digest(docs: DataFrame) -> DataFrame:
    """Add `digest`: identity of the content, blind to file name and order.

    Numbers are written with six decimals. A document is bounded by its
    writer's buffers, so its parts fit one row.
    """
    head = F.array(
        F.concat(F.lit("collector:"), F.col("collector")),
        F.concat(F.lit("version:"), F.coalesce("collector_version", F.lit(""))),
        F.concat(F.lit("schema:"), F.col("schema_version")),
        F.concat(F.lit("written:"), _digits(F.col("written_at"))),
        F.concat(F.lit("uptime:"), _digits(F.col("uptime_ms"))),
    )
    s = F.transform(
        "samples",
        lambda x: F.concat(
            F.lit("s:"), x["metric"], F.lit(":"), _digits(x["value"]), F.lit(":"), x["unit"], F.lit(":"),
            _digits(x["at"]), F.lit(":"), F.coalesce(_digits(x["player_count"]), F.lit("")),
        ),
    )
    e = F.transform(
        "events",
        lambda x: F.concat(
            F.lit("e:"), x["kind"], F.lit(":"), F.coalesce(x["resource"], F.lit("")), F.lit(":"),
            F.coalesce(x["detail"], F.lit("")), F.lit(":"), _digits(x["at"]),
        ),
    )
    return docs.withColumn("digest", fingerprint(F.concat(head, s, e)))


def ingest_once(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add `status`: IMPORTED, or ALREADY_IMPORTED for a known digest.

    Of equal documents in one read the first in path order is imported. The
    winner is a combinable minimum per digest, not a window over the copies, so
    a document copied millions of times stays cheap.
    """
    known = ledger.select("server_id", "digest").distinct().withColumn("_known", F.lit(True))
    first = docs.groupBy("server_id", "digest").agg(F.min("file").alias("_first"))
    verdicts = first.join(known, ["server_id", "digest"], "left")
    fresh = F.col("_known").isNull() & (F.col("file") == F.col("_first"))
    return (
        docs.join(verdicts, ["server_id", "digest"])
        .withColumn("status", F.when(fresh, "IMPORTED").otherwise("ALREADY_IMPORTED"))
        .drop("_known", "_first")
    )


def import_documents(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """Parse, digest and judge documents; a text is read, hashed and parsed at most once.

    A filter of fixed size over the bytes the ledger knows (`raw_digest`) is asked in the
    scan that reads the texts. What it rules out is new and is parsed there; the others
    leave that scan without their text, as keys, and only keys meet the ledger. Texts that
    passed the filter by chance are found by a filter of their own and read again. So no
    text is shuffled, but for those few. Known texts come back with their status and
    without content. The first copy of each digest is found on three narrow columns.
    """
    raw = raw.withColumn("raw_digest", F.sha2("json", 256))
    if "raw_digest" not in ledger.columns:
        return ingest_once(cut_lineage(with_digest(documents(parse(raw)))), ledger)
    keys = ["server_id", "raw_digest"]
    key = F.struct(*keys)
    known = ledger.where("raw_digest is not null").select(*keys)
    asked = may_match(raw, key, key_filter(known, key), "_asked")
    parsed = parse(asked.withColumn("json", F.when(~F.col("_asked"), F.col("json"))))
    staged = cut_lineage(with_digest(parsed.where(F.col("reason").isNull() | F.col("_asked"))))
    new = documents(staged.where(~F.col("_asked"))).drop("_asked")
    narrow = staged.where("_asked").select(*[c for c in raw.columns if c != "json"])
    by_chance, n = cut_and_count(narrow.join(known, keys, "left_anti"))
    if n:
        likely = may_match(raw, key, key_filter(by_chance, key), "_asked").where("_asked").drop("_asked")
        again = likely.join(by_chance.select(*keys).distinct(), keys, "left_semi")
        new = new.unionByName(cut_lineage(with_digest(documents(parse(again)))))
    seen = narrow.join(known, keys, "left_semi").withColumn("status", F.lit("ALREADY_IMPORTED"))
    return ingest_once(new, ledger).unionByName(seen, allowMissingColumns=True)


def ledger_rows(ingested: DataFrame, imported_at: Column) -> DataFrame:
    """Ledger entries of the imported documents; a writer without clock: NULL."""
    return ingested.where(F.col("status") == "IMPORTED").select(
        "server_id",
        F.col("file").alias("path"),
        "digest",
        "collector",
        "collector_version",
        "schema_version",
        F.size("samples").cast("bigint").alias("sample_count"),
        F.size("events").cast("bigint").alias("event_count"),
        "dropped_samples",
        "dropped_events",
        F.when(F.col("written_at") > 0, seconds_to_timestamp(F.col("written_at"))).alias("written_at"),
        imported_at.alias("imported_at"),
        *[c for c in ("raw_digest",) if c in ingested.columns],
    )


def runtime_state(ledger: DataFrame) -> DataFrame:
    """What has been imported per server; totals default to 0, times stay NULL."""
    zero = F.lit(0).cast("bigint")
    return ledger.groupBy("server_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("sample_count", "event_count", "dropped_samples", "dropped_events")],
        F.min("imported_at").alias("first_import"),
        F.max("imported_at").alias("last_import"),
        F.max("written_at").alias("last_written"),
    )


def collector_versions(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("collector_version").isNotNull()).select("server_id", "collector_version").distinct()


def recent_events(events: DataFrame, n: int = 50, server: str | None = None) -> DataFrame:
    scoped = events if server is None else events.where(F.col("server_id") == server)
    return scoped.orderBy(F.col("observed_at").desc(), F.col("id").desc()).limit(n)


def record_samples(samples: DataFrame, path: str) -> None:
    """Append finite samples, partitioned so that later reads prune by server."""
    samples.where(finite("value")).write.mode("append").partitionBy("server_id").parquet(path)


def load_samples(
    samples: DataFrame,
    resource: str | None = None,
    metric: str | None = None,
    since: str | None = None,
    until: str | None = None,
    baseline: str | None = None,
) -> DataFrame:
    """Optional filters, all of which reach the scan."""
    out = samples
    if baseline is not None:
        out = out.where(F.col("baseline_label") == baseline)
    if resource is not None:
        out = out.where(F.col("resource") == resource)
    if metric is not None:
        out = out.where(F.col("metric") == metric)
    if since is not None:
        out = out.where(F.col("sampled_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("sampled_at") <= F.lit(until).cast("timestamp"))
    return out


def performance_section(parsed: DataFrame) -> DataFrame:
    """The summary with the number of documents that could not be read, in one pass.

    `collected` means any sample. The reasons are rows of `problems`.
    """
    good = F.col("reason").isNull()
    totals = parsed.agg(*_totals(good), F.count_if(~good).alias("unreadable_documents"))
    return _summary(totals, "unreadable_documents").withColumn("collected", F.col("sample_count") > 0)
