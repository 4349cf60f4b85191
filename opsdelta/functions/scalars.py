"""Column helpers shared by the operators. Everything stays JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

EPSILON = 2.220446049250313e-16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x: str | Column, digits: int = 0) -> Column:
    """Half up toward +infinity on the binary double; not `round()`.

    From 2^52 on a scaled double has no fraction to round, and floor's BIGINT would
    end at 2^63; such values, infinities and NaN stay as they are.
    """
    k = float(10**digits)
    v = col(x).cast("double")
    return F.when(F.abs(v * k) < float(1 << 52), F.floor(v * k + F.lit(0.5)) / F.lit(k)).otherwise(v)


def r6(x: str | Column) -> Column:
    return js_round(x, 6)


def fixed_text(x: str | Column, digits: int) -> Column:
    """A number with exactly `digits` decimals, rounded as `js_round` does."""
    rounded = js_round(x, digits)
    return F.coalesce(rounded.try_cast(f"decimal(28,{digits})").cast("string"), rounded.cast("string"))


def iso(ts: str | Column) -> Column:
    """ISO-8601 UTC text with milliseconds."""
    return F.date_format(col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def finite(x: str | Column) -> Column:
    """True for a real number: not NULL, not NaN, not infinite."""
    c = col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def relative_change(before: str | Column, after: str | Column) -> Column:
    """(after - before) / before; a zero base gives 0 or +infinity."""
    b, a = col(before).cast("double"), col(after).cast("double")
    return (
        F.when((b == 0) & (a == 0), F.lit(0.0))
        .when(b == 0, F.lit(float("inf")))
        .otherwise(F.try_divide(a - b, b))
    )


def format_percentage(change: str | Column) -> Column:
    """Fixed format: '+12.34%', '-1.00%', '0.00%' or 'not comparable'."""
    c = col(change)
    pct = fixed_text(c * 100, 2)
    return F.when(
        finite(c), F.concat(F.when(c > 0, F.lit("+")).otherwise(F.lit("")), pct, F.lit("%"))
    ).otherwise(F.lit("not comparable"))


def format_duration(ms: str | Column) -> Column:
    """Fixed format: '42s', '5m' or '1.5h', rounding at each step."""
    seconds = js_round(col(ms) / 1000.0)
    minutes = js_round(seconds / 60.0)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("bigint").cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("bigint").cast("string"), F.lit("m")))
        .otherwise(F.concat(fixed_text(minutes / 60.0, 1), F.lit("h")))
    )


def deterministic_id(prefix: str, *parts: str | Column) -> Column:
    """`prefix_` and 16 hex digits of the hash of the space-joined parts."""
    text = reduce(
        lambda acc, p: F.concat(acc, F.lit(" "), p),
        [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts],
    )
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, 16))


def finding_id(rule, resource, file, line, discriminator) -> Column:
    """Content-derived id; an absent line counts as -1, other absences as ''."""
    return deterministic_id(
        "fnd", rule, resource, file, F.coalesce(col(line).cast("string"), F.lit("-1")), discriminator
    )


def fingerprint(parts: Column) -> Column:
    """Hash of a bounded array: sorted parts, each followed by one space."""
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(parts), lambda p: F.concat(p, F.lit(" ")))), 256)


LANES = 9
LANE_HEX = 7


def set_digest(part: str | Column) -> Column:
    """Order-free hash of a group of any size, as one aggregate.

    Every row's SHA-256 is cut into nine 28-bit lanes and the lanes are summed;
    the digest hashes the sums. Sums combine before the shuffle, so a group that
    holds most of the table still costs each task nine counters, where sorting
    and joining the parts would put the whole group into one task.
    """
    sha = F.sha2(col(part), 256)
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(sha, 1 + i * LANE_HEX, LANE_HEX), 16, 10).cast("bigint")), F.lit(0)
        ).cast("string")
        for i in range(LANES)
    ]
    return F.sha2(F.concat_ws(":", *sums), 256)


def normalize_confidence(c: str | Column) -> Column:
    """Clamp to [0, 1] with two decimals; NULL for a value that is no number."""
    x = col(c)
    return F.when(finite(x), js_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 2))


def confidence_band(c: str | Column) -> Column:
    x = col(c)
    out = F.when(x >= fixed.CONFIDENCE_BANDS[0][0], F.lit(fixed.CONFIDENCE_BANDS[0][1]))
    for low, name in fixed.CONFIDENCE_BANDS[1:]:
        out = out.when(x >= low, F.lit(name))
    return out.otherwise(F.lit("VERY_LOW"))


def severity_rank(s: str | Column) -> Column:
    """0 for INFO up to 4 for CRITICAL; NULL for anything else."""
    x = col(s)
    out = F.when(x == fixed.SEVERITIES[0], F.lit(0))
    for rank, name in enumerate(fixed.SEVERITIES[1:], 1):
        out = out.when(x == name, F.lit(rank))
    return out


def severity_name(rank: str | Column) -> Column:
    x = col(rank)
    return F.element_at(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), (x + 1).cast("int"))


def glob_to_regex(glob: str | Column) -> Column:
    """Anchored regular expression for a path glob: `**/`, `**`, `*` and `?`.

    Wildcards are first parked on control characters, so that their expansions
    are not themselves read as wildcards.
    """
    g = F.regexp_replace(col(glob), r"\\", "/")
    g = F.regexp_replace(g, r"([.+^${}()|\[\]\\])", r"\\$1")
    g = F.regexp_replace(g, r"\*\*/", "\u0001")
    g = F.regexp_replace(g, r"\*\*", "\u0002")
    g = F.regexp_replace(g, r"\*", "[^/]*")
    g = F.regexp_replace(g, r"\?", "[^/]")
    g = F.regexp_replace(g, "\u0001", "(?:[^/]*/)*")
    g = F.regexp_replace(g, "\u0002", ".*")
    return F.concat(F.lit("^"), g, F.lit("$"))


def is_glob(pattern: str | Column) -> Column:
    return F.instr(col(pattern), "*").__gt__(0) | F.instr(col(pattern), "?").__gt__(0)


def extension(path: str | Column) -> Column:
    """Lower-case extension of the last path segment, without the dot; '' for none."""
    return F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]*)$", 1))


def classify_file(path: str | Column) -> Column:
    ext = extension(path)
    table = F.create_map(*[F.lit(x) for pair in fixed.FILE_TYPES.items() for x in pair])
    return F.when(ext == "", F.lit("unknown")).otherwise(F.coalesce(F.try_element_at(table, ext), ext))


def lateness(requested_ms: str | Column, elapsed_ms: str | Column) -> Column:
    return F.greatest(F.lit(0.0), col(elapsed_ms) - col(requested_ms))


def lines(text: str | Column) -> Column:
    """Array of lines; both line endings count."""
    return F.split(col(text), r"\r?\n")


def compact(*cases: Column) -> Column:
    """Array of the cases that hold, in order."""
    return F.array_compact(F.array(*cases))


# Values longer than this without a space are shortened for display.
MASK_LONG = 64


def mask_secret(value: str | Column, prefix: int = 4) -> Column:
    """Keep at most `prefix` and at most a quarter of the characters."""
    v = col(value)
    kept = F.least(F.lit(prefix), F.floor(F.length(v) / 4).cast("int"))
    return F.concat(F.substr(v, F.lit(1), kept), F.lit(fixed.MASK))


def sha_id(prefix: str, text: str | Column) -> Column:
    """`prefix` and 16 hex digits of a text's hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(col(text), 256), 1, 16))
