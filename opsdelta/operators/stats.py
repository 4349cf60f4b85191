"""Sample statistics per group, exact and safe for a hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite
from ..session import cut_lineage

STATS = ["sample_count", "mean", "median", "p95", "min", "max", "standard_deviation", "coefficient_of_variation"]


def moments(value: str, where: Column | None = None, mean=F.avg) -> dict[str, Column]:
    """Count, mean and population deviation as combinable aggregates."""
    v = F.when(finite(value) & where if where is not None else finite(value), F.col(value))
    return {"n": F.count(v), "mean": F.coalesce(mean(v), F.lit(0.0)), "sd": F.coalesce(F.stddev_pop(v), F.lit(0.0))}


def exact_sum(v: Column) -> Column:
    """A sum that no order of the rows changes: values count in millionths.

    Sums of doubles differ in their last digit from run to run, which shows where they are
    rounded for display. If a value is no DECIMAL(28,6), the sum is that of doubles.
    """
    d = v.try_cast("decimal(28,6)")
    return F.when(F.count(d) == F.count(v), F.sum(d).cast("double")).otherwise(F.sum(v))


def exact_mean(v: Column) -> Column:
    return F.try_divide(exact_sum(v), F.count(v).cast("double"))


def variation(sd: Column, mean: Column) -> Column:
    return F.when(mean == 0, F.lit(0.0)).otherwise(F.try_divide(sd, mean))


def _fractions(ps: list[float]) -> list[float]:
    return [min(100.0, max(0.0, p)) / 100.0 for p in ps]


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[float]) -> DataFrame:
    """Exact linearly interpolated percentiles: columns `by`, `n`, `p0`, `p1`…

    Distributed selection, the same for groups of every size. Rows fold to (group, value,
    count); these are dealt out by ranges of (group, value) and written, so a hot group
    lies in many parts, in order. The counts per group and part tell how many values lie
    before each part, and so which parts hold a wanted rank: only those are read again,
    and a running count inside a part picks the values.
    """
    fractions = _fractions(ps)
    folded = df.where(finite(value)).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    folded = cut_lineage(folded.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    parts = folded.groupBy(*by, "_part").agg(F.sum("_c").alias("_m"))
    group, up_to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_part")
    placed = parts.select(*by, "_part", (F.sum("_m").over(up_to) - F.col("_m")).alias("_below"), F.sum("_m").over(group).alias("n"), "_m")
    at = [(F.col("n") - 1) * F.lit(p) for p in fractions]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), cut(r).cast("bigint").alias("rank")) for i, r in enumerate(at) for side, cut in enumerate((F.floor, F.ceil))])
    held = F.filter(ranks, lambda r: (r["rank"] >= F.col("_below")) & (r["rank"] < F.col("_below") + F.col("_m")))
    live = placed.select(*by, "_part", "_below", "n", held.alias("_ranks")).where(F.size("_ranks") > 0)
    running = Window.partitionBy(*by, "_part").orderBy("_v")
    ended = _join(folded, live, [*by, "_part"]).withColumn("_end", F.col("_below") + F.sum("_c").over(running))
    mine = F.filter("_ranks", lambda r: (r["rank"] < F.col("_end")) & (r["rank"] >= F.col("_end") - F.col("_c")))
    found = ended.select(*by, "n", "_v", F.explode(mine).alias("_r"))
    picked = found.groupBy(*by, "n").agg(
        *[F.max(F.when((F.col("_r.i") == i) & (F.col("_r.side") == side), F.col("_v"))).alias(f"_v{i}_{side}") for i in range(len(ps)) for side in (0, 1)]
    )
    return picked.select(*by, "n", *[_between(F.col(f"_v{i}_0"), F.col(f"_v{i}_1"), r).alias(f"p{i}") for i, r in enumerate(at)])


def _between(low: Column, high: Column, rank: Column) -> Column:
    return F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join on keys that may be NULL."""
    r = right.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(by)], *[c for c in right.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_r{i}")) for i, b in enumerate(by)])
    return left.join(r, on).drop(*[f"_r{i}" for i in range(len(by))])


def summarize(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The eight statistics per group; a group without a finite value is all zero."""
    m = moments(value)
    v = F.when(finite(value), F.col(value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    simple = [
        m["n"].alias("sample_count"),
        m["mean"].alias("mean"),
        zero(F.min(v)).alias("min"),
        zero(F.max(v)).alias("max"),
        m["sd"].alias("standard_deviation"),
    ]
    ranks = percentiles(df, by, value, [50.0, 95.0])
    named = ranks.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(by)], F.col("p0").alias("median"), F.col("p1").alias("p95"))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_r{i}")) for i, b in enumerate(by)], F.lit(True))
    out = df.groupBy(*by).agg(*simple).join(named, on, "left")
    return out.select(
        *by,
        "sample_count",
        "mean",
        zero(F.col("median")).alias("median"),
        zero(F.col("p95")).alias("p95"),
        "min",
        "max",
        "standard_deviation",
        variation(F.col("standard_deviation"), F.col("mean")).alias("coefficient_of_variation"),
    )
