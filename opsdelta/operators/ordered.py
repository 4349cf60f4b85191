"""Ordered computations that survive a hot key.

A plain `Window.partitionBy(key).orderBy(...)` sorts a whole key in one task.
These helpers split every key into chunks of its own order (a time span, or a
prefix of the sort key), run the window inside each chunk, and pass only one
summary row per chunk across chunk borders. The answers are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_chunk(ts: str, span: str) -> Column:
    """Number of the span a timestamp falls in."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(_micros(span))).cast("bigint")


def _micros(span: str) -> int:
    units = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
    return int(span[:-1]) * units[span[-1]]


def with_previous(
    df: DataFrame, keys: list[str], ts: str, tie: str | None, values: list[str], span: str = "1d"
) -> DataFrame:
    """Add `prev_<value>` for each value: the one of the row before, per key."""
    order = [ts] + ([tie] if tie else [])
    chunked = df.withColumn("_chunk", time_chunk(ts, span))
    row = F.struct(*[F.col(v) for v in values])
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = chunked.withColumn("_prev", F.lag(row).over(inner)).withColumn(
        "_first", F.row_number().over(inner) == 1
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    tails = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.max_by(row, F.struct(*[F.col(o) for o in order])).alias("_tail"))
        .withColumn("_before", F.lag("_tail").over(across))
        .select(*keys, "_chunk", "_before")
    )
    joined = inside.join(tails, [*keys, "_chunk"])
    prev = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    out = joined.withColumn("_p", prev)
    for v in values:
        out = out.withColumn(f"prev_{v}", F.col(f"_p.{v}"))
    return out.drop("_chunk", "_prev", "_first", "_before", "_p")


def ranked(
    df: DataFrame, keys: list[str], prefix: list[tuple[Column, bool]], rest: list[Column], name: str = "position"
) -> DataFrame:
    """Exact 1-based row number per key, ordered by `prefix` then `rest`.

    `prefix` lists (expression, descending). Rows are numbered inside each
    (key, prefix) chunk; the chunk's offset is a running sum over chunk counts.
    Choose a prefix of few distinct values per key.
    """
    pnames = [f"_p{i}" for i in range(len(prefix))]
    base = df.select("*", *[c.alias(n) for (c, _), n in zip(prefix, pnames)])
    order = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(pnames, prefix)]
    across = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, *pnames)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias(f"_o_{c}") for c in [*keys, *pnames]],
            F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"),
        )
    )
    inner = Window.partitionBy(*keys, *pnames).orderBy(*rest)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*keys, *pnames]])
    return (
        base.withColumn("_r", F.row_number().over(inner))
        .join(offsets, on)
        .withColumn(name, (F.col("_r") + F.col("_offset")).cast("bigint"))
        .select(*df.columns, name)
    )


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_ms: int, span: str = "1d") -> DataFrame:
    """Add `session_start`: a row starts a session when its gap exceeds `gap_ms`.

    Equality stays together. Only distinct times matter, so they are reduced
    before any ordering; a burst of equal times costs one row.
    """
    times = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t")).distinct()
    marked = with_previous(times, keys, "_t", None, ["_t"], span).withColumn(
        "_start",
        F.when(
            F.col("prev__t").isNull() | (F.unix_millis("_t") - F.unix_millis("prev__t") > F.lit(gap_ms)), F.col("_t")
        ),
    )
    chunked = marked.withColumn("_chunk", time_chunk("_t", span))
    inner = Window.partitionBy(*keys, "_chunk").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_local", F.max("_start").over(inner))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.max("_start").alias("_last"))
        .withColumn("_carry", F.max("_last").over(across))
        .select(*keys, "_chunk", "_carry")
    )
    spans = local.join(carried, [*keys, "_chunk"]).select(
        *keys, "_t", F.coalesce("_local", "_carry").alias("session_start")
    )
    return df.join(spans.withColumnRenamed("_t", ts), [*keys, ts])


def last_within(
    facts: DataFrame, asks: DataFrame, keys: list[str], at: str, value: str, reach: int, parts: int = 64
) -> DataFrame:
    """(keys, at, value) for each ask whose last fact at or before it is at most `reach` back."""
    found = last_values_within(facts, asks, keys, at, [value], reach, parts)
    return found.where(F.col(f"{value}_at").isNotNull()).select(*keys, at, value)


def last_values_within(
    facts: DataFrame, asks: DataFrame, keys: list[str], at: str, values: list[str], reach: int, parts: int = 64
) -> DataFrame:
    """Every ask with, per value, the last one at or before it and its time `<value>_at`, NULL if more than `reach` back.

    `facts` hold one row per keys and `at` (a whole number) and one or more of the values;
    `asks` hold keys, `at` and any other columns; no key is NULL. Time is cut into parts of
    `reach / parts`. Inside a part the last
    fact runs along the sorted times; the last fact of the parts before it, `parts` to
    twice as many, comes from one row a part. So the rows one task must see together are
    bounded by the times in a part and by the number of parts, however busy a key is.
    """
    width = -(-reach // parts)
    others = [c for c in asks.columns if c not in (*keys, at)]
    part = F.floor(F.col(at) / F.lit(width)).cast("bigint")
    own_slice = F.floor(F.col("_part") / F.lit(parts)).cast("bigint")
    pairs = [c for v in values for c in (v, f"{v}_at")]
    told = facts.select(
        *keys, at, part.alias("_part"),
        *[c for v in values for c in (F.col(v), F.when(F.col(v).isNotNull(), F.col(at)).alias(f"{v}_at"))],
    )
    asked = asks.select(*keys, at, part.alias("_part"), *others)
    both = told.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_part").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    inside = both.select(
        *keys, at, "_part", "_ask", *others, *[F.last(c, ignorenulls=True).over(so_far).alias(f"_in_{c}") for c in pairs]
    ).where("_ask")
    tails = (
        told.groupBy(*keys, "_part")
        .agg(*[f for v in values for f in (F.max_by(v, f"{v}_at").alias(v), F.max(f"{v}_at").alias(f"{v}_at"))])
        .select("*", F.lit(False).alias("_ask"), F.explode(F.array(own_slice, own_slice + 1)).alias("_slice"))
    )
    heads = asked.select(*keys, "_part").distinct().select("*", F.lit(True).alias("_ask"), own_slice.alias("_slice"))
    earlier = Window.partitionBy(*keys, "_slice").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.unionByName(heads, allowMissingColumns=True)
        .select(*keys, "_part", "_ask", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in pairs])
        .where("_ask")
        .drop("_ask")
    )
    last = lambda c: F.coalesce(f"_in_{c}", f"_carry_{c}")
    near = lambda v: F.col(at) - last(f"{v}_at") <= F.lit(reach)
    return inside.join(carried, [*keys, "_part"]).select(
        *asks.columns, *[F.when(near(v), last(c)).alias(c) for v in values for c in (v, f"{v}_at")]
    )
