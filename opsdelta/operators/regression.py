"""Before/after comparison of metrics with an explained verdict per metric."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPSILON, fixed_text, format_percentage, js_round, relative_change
from .stats import STATS, moments, summarize, variation

KEYS = ["resource", "metric"]


@dataclass(frozen=True)
class Thresholds:
    """When a difference counts. The player limit is off unless given."""

    min_absolute: float = 0.2
    min_relative: float = 0.5
    min_samples: int = 8
    max_variation: float = 0.75
    max_player_delta: float | None = None


def compare_windows(samples: DataFrame, side: str = "side", keys: list[str] = KEYS, mean=F.avg) -> DataFrame:
    """Moments of both windows in one pass over rows tagged 'before' or 'after'.

    Conditional aggregates replace two groupings and a full outer join, and the
    partial aggregation keeps a hot metric from reaching one task. Other tags
    (or NULL) are ignored. The unit is that of the earlier window when it has one.
    Text made of the means wants `stats.exact_mean` as `mean`.
    """
    aggs = []
    for tag in ("before", "after"):
        here = F.col(side) == tag
        m = moments("value", here, mean)
        aggs += [
            F.count(F.when(here, F.lit(1))).alias(f"{tag}_rows"),
            m["n"].alias(f"{tag}_count"),
            m["mean"].alias(f"{tag}_mean"),
            m["sd"].alias(f"{tag}_sd"),
            F.avg(F.when(here, F.col("player_count"))).alias(f"{tag}_players"),
            F.min(F.when(here, F.col("unit"))).alias(f"{tag}_unit"),
        ]
    return (
        samples.where(F.col(side).isin("before", "after"))
        .groupBy(*keys)
        .agg(*aggs)
        .withColumn("unit", F.coalesce("before_unit", "after_unit"))
        .drop("before_unit", "after_unit")
    )


def window_summaries(samples: DataFrame, side: str = "side", keys: list[str] = KEYS) -> DataFrame:
    """All eight statistics of both windows, one row per key (absent side: zeros)."""
    long = summarize(samples.where(F.col(side).isin("before", "after")), [*keys, side], "value")
    return long.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col(side) == tag, F.col(s))), F.lit(0)).alias(f"{tag}_{s}")
            for tag in ("before", "after")
            for s in STATS
        ]
    )


def judge(compared: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add the changes, the verdict (first rule that applies) and its confidence."""
    delta, rel = F.col("absolute_change"), F.col("relative_change")
    verdict = F.when(
        (F.col("before_count") < t.min_samples) | (F.col("after_count") < t.min_samples), "INSUFFICIENT_SAMPLES"
    )
    if t.max_player_delta is not None:
        verdict = verdict.when(
            F.abs(F.col("after_players") - F.col("before_players")) > t.max_player_delta, "CONTEXT_MISMATCH"
        )
    verdict = (
        verdict.when(F.col("before_cv") > t.max_variation, "BASELINE_TOO_NOISY")
        .when((delta < 0) & (F.abs(rel) >= t.min_relative), "IMPROVEMENT")
        .when((delta < t.min_absolute) & (delta <= 0), "UNCHANGED")
        .when(delta < t.min_absolute, "BELOW_ABSOLUTE_THRESHOLD")
        .when(rel < t.min_relative, "BELOW_RELATIVE_THRESHOLD")
        .otherwise("REGRESSION")
    )
    return (
        compared.withColumn("before_cv", variation(F.col("before_sd"), F.col("before_mean")))
        .withColumn("after_cv", variation(F.col("after_sd"), F.col("after_mean")))
        .withColumn("absolute_change", F.col("after_mean") - F.col("before_mean"))
        .withColumn("relative_change", relative_change("before_mean", "after_mean"))
        .withColumn("verdict", verdict)
        .withColumn("confidence", confidence())
    )


def confidence() -> Column:
    """0.25–0.90 for a detected change, else 0: separation, samples, magnitude."""
    spread = F.greatest(F.col("before_sd"), F.col("after_sd"), F.lit(EPSILON))
    separation = F.least(F.lit(1.0), F.abs(F.col("absolute_change")) / spread / 3)
    samples = F.least(F.lit(1.0), F.least("before_count", "after_count") / 60)
    magnitude = F.least(F.lit(1.0), F.abs(F.col("relative_change")) / 2)
    score = 0.5 * separation + 0.3 * samples + 0.2 * magnitude
    clamped = js_round(F.least(F.lit(0.9), F.greatest(F.lit(0.25), score)), 2)
    return F.when(F.col("verdict").isin("REGRESSION", "IMPROVEMENT"), clamped).otherwise(F.lit(0.0))


def explain_verdict(judged: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add one sentence per row that names the numbers behind the verdict."""
    m, u = F.col("metric"), F.col("unit")
    moved = F.concat(
        fixed_text("before_mean", 3), F.lit(" to "), fixed_text("after_mean", 3), F.lit(" "), u,
        F.lit(" ("), format_percentage("relative_change"), F.lit(")"),
    )
    counts = F.concat(F.col("before_count").cast("string"), F.lit(" and "), F.col("after_count").cast("string"))
    text = (
        F.when(F.col("verdict") == "INSUFFICIENT_SAMPLES",
               F.concat(counts, F.lit(f" samples; each side needs {t.min_samples}")))
        .when(F.col("verdict") == "CONTEXT_MISMATCH",
              F.concat(F.lit("player load differs: "), fixed_text("before_players", 2), F.lit(" and "),
                       fixed_text("after_players", 2)))
        .when(F.col("verdict") == "BASELINE_TOO_NOISY",
              F.concat(F.lit("earlier window varies by "), format_percentage("before_cv"), F.lit(" of its mean")))
        .when(F.col("verdict") == "IMPROVEMENT", F.concat(m, F.lit(" fell from "), moved))
        .when(F.col("verdict") == "UNCHANGED", F.concat(m, F.lit(" did not rise")))
        .when(F.col("verdict") == "BELOW_ABSOLUTE_THRESHOLD",
              F.concat(m, F.lit(" rose by "), fixed_text("absolute_change", 3), F.lit(" "), u,
                       F.lit(f", under {t.min_absolute} "), u))
        .when(F.col("verdict") == "BELOW_RELATIVE_THRESHOLD",
              F.concat(m, F.lit(" rose by "), format_percentage("relative_change"), F.lit(", under "),
                       format_percentage(F.lit(t.min_relative))))
        .otherwise(F.concat(m, F.lit(" rose from "), moved, F.lit(" over "), counts, F.lit(" samples")))
    )
    return judged.withColumn("explanation", text)


def regression_findings(judged: DataFrame, before_label: str, after_label: str) -> DataFrame:
    """A finding per REGRESSION, with its three measurements as evidence."""
    from ..functions import finding_id

    def measure(what: str, value: Column, unit: Column, n: str) -> Column:
        return F.struct(
            F.lit("MEASUREMENT").alias("kind"),
            F.lit(what).alias("description"),
            js_round(value, 4).alias("value"),
            unit.alias("unit"),
            F.col(n).alias("sample_count"),
        )

    what = F.concat(F.lit(f"{before_label}->{after_label}:"), F.col("metric"))
    return judged.where(F.col("verdict") == "REGRESSION").select(
        finding_id(F.lit("PERF-REGRESSION-001"), "resource", F.lit(""), F.lit(None).cast("string"), what).alias("id"),
        F.lit("PERF-REGRESSION-001").alias("rule_id"),
        F.lit("PERFORMANCE").alias("category"),
        F.when(F.col("relative_change") >= 1, "HIGH").otherwise("MEDIUM").alias("severity"),
        "confidence",
        "resource",
        "metric",
        F.array(
            measure("mean before", F.col("before_mean"), F.col("unit"), "before_count"),
            measure("mean after", F.col("after_mean"), F.col("unit"), "after_count"),
            measure("spread before", F.col("before_cv"), F.lit("ratio"), "before_count"),
        ).alias("evidence"),
    )


def compared_guard(samples: DataFrame, side: str = "side") -> DataFrame:
    """One row: were the windows comparable at all, and if not, why not."""
    counts = samples.agg(
        F.count(F.when(F.col(side) == "before", F.lit(1))).alias("before_rows"),
        F.count(F.when(F.col(side) == "after", F.lit(1))).alias("after_rows"),
    )
    b, a = F.col("before_rows"), F.col("after_rows")
    return counts.select(
        ((b > 0) & (a > 0)).alias("compared"),
        F.when((b == 0) & (a == 0), F.lit("no samples on either side"))
        .when(
            (b == 0) | (a == 0),
            F.concat(F.lit("samples on one side only: "), b.cast("string"), F.lit(" and "), a.cast("string")),
        )
        .alias("reason"),
        "before_rows",
        "after_rows",
    )
