"""Range joins rewritten as equi-joins on buckets.

A pure range predicate makes Catalyst fall back to a nested loop. Both sides
are given a bucket number instead, one side is copied into at most two buckets
(of its own level, where its reach varies), and the exact predicate stays as a
residual filter. Hot buckets are split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, low: int, high: int
) -> DataFrame:
    """Pairs with equal keys and `low <= right_at - left_at <= high`.

    Column names must differ between the sides but for the keys.
    """
    width = max(high - low, 1)
    lb = F.floor((left_at + F.lit(low)) / F.lit(width)).cast("bigint")
    a = left.withColumn("_at_l", left_at).withColumn("_b", F.explode(F.sequence(lb, lb + 1)))
    b = right.withColumn("_at_r", right_at).withColumn("_b", F.floor(right_at / F.lit(width)).cast("bigint"))
    delta = F.col("_at_r") - F.col("_at_l")
    return (
        a.join(b, [*keys, "_b"])
        .where((delta >= low) & (delta <= high))
        .withColumn("_delta", delta)
        .drop("_b", "_at_l", "_at_r")
    )


def disjoint_join(
    points: DataFrame, spans: DataFrame, keys: list[str], at: Column, lo: Column, hi: Column, width: int, how: str = "inner"
) -> DataFrame:
    """Points with the `[lo, hi)` span around them, where the spans of a key do not overlap.

    Spans are copied into every bucket of `width` they touch. Being disjoint they come to
    at most one row a span and one a bucket of the key's range, and points stay one row.
    """
    p = points.withColumn("_at", at).withColumn("_b", F.floor(at / F.lit(width)).cast("bigint"))
    s = (
        spans.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_hi") > F.col("_lo"))
        .withColumn(
            "_b",
            F.explode(
                F.sequence(
                    F.floor(F.col("_lo") / F.lit(width)).cast("bigint"),
                    F.floor((F.col("_hi") - 1) / F.lit(width)).cast("bigint"),
                )
            ),
        )
    )
    cond = [p[k] == s[k] for k in keys] + [p["_b"] == s["_b"], F.col("_at") >= F.col("_lo"), F.col("_at") < F.col("_hi")]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    joined = p.join(s, on, how)
    out = [p[c] for c in points.columns] + [s[c] for c in spans.columns if c not in keys]
    return joined.select(*out)


STEP = 2  # blocks of one level are 2**STEP times as wide as those of the level below


def _level(length: Column, width: int) -> Column:
    """Least level whose blocks are at least as wide as the span."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.ceil(length / F.lit(width))) / F.lit(STEP))).cast("int")


def _block(at: Column, level: Column, width: int) -> Column:
    """Number of the block of `level` that holds the point; a shift rounds down, also below 0."""
    return F.call_function("shiftright", F.floor(at / F.lit(width)).cast("bigint"), (level * F.lit(STEP)).cast("int"))


def span_blocks(lo: Column, hi: Column, width: int) -> Column:
    """The one or two (level, block) pairs that cover `[lo, hi)`, however long it is."""
    level = _level(hi - lo, width)
    return F.transform(
        F.array_distinct(F.array(_block(lo, level, width), _block(hi - F.lit(1), level, width))),
        lambda b: F.struct(level.alias("level"), b.alias("block")),
    )


def interval_join(
    points: DataFrame, spans: DataFrame, keys: list[str], at: Column, lo: Column, hi: Column, width: int
) -> DataFrame:
    """Points inside `[lo, hi)` spans with equal keys.

    A span goes to the level of blocks that its length calls for and fills at most two
    of them; a point looks in its block of every level that some span uses. Those levels
    are one row of a few numbers. The narrowest blocks are `width` wide.
    """
    others = [c for c in spans.columns if c not in keys]
    valid = spans.select(*keys, F.struct(*others).alias("_span"), lo.alias("_lo"), hi.alias("_hi")).where("_hi > _lo")
    levels = valid.agg(F.collect_set(_level(F.col("_hi") - F.col("_lo"), width)).alias("_levels"))
    s = valid.withColumn("_c", F.explode(span_blocks(F.col("_lo"), F.col("_hi"), width))).select(
        *keys, "_span", "_lo", "_hi", F.col("_c.level").alias("_level"), F.col("_c.block").alias("_b")
    )
    p = points.select(*keys, F.struct(*points.columns).alias("_point"), at.alias("_at"), F.explode(levels.scalar()).alias("_level"))
    p = p.withColumn("_b", _block(F.col("_at"), F.col("_level"), width))
    return p.join(s, [*keys, "_level", "_b"]).where("_at >= _lo and _at < _hi").select("_point.*", "_span.*")
