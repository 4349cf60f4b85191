"""Corpus scanning: redaction, secrets, obfuscation indicators, call sites.

Texts are processed whole. Everything is built from JVM
expressions; regular expressions avoid repeated groups over long runs, which
Java would evaluate recursively.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, fixed, js_round, lines

SENSITIVE_KEY_ONLY = f"(?i)^{fixed.SENSITIVE_KEY}$"

# A text without any of these has nothing to redact, so the nine replacements
# can be skipped. Every redaction pattern needs at least one of them.
MAYBE_SECRET = (
    r"(?i)://|PRIVATE KEY-----|authorization|eyJ|\.[A-Za-z0-9_-]{6}\.|passw|pwd|secret|token|key|credential"
    r"|webhook|connection|db[_-]?pass"
)


def redact_text(text: str | Column) -> Column:
    """The nine patterns in order; each sees the text the one before it left."""
    t = col(text)
    redacted = reduce(lambda acc, p: F.regexp_replace(acc, p[1], p[2]), fixed.REDACTIONS, t)
    return F.when(t.rlike(MAYBE_SECRET), redacted).otherwise(t)


def contains_secret(text: str | Column) -> Column:
    return redact_text(text) != col(text)


def secret_shaped(text: Column) -> Column:
    return F.coalesce(contains_secret(text), F.lit(False))


def redact_map(m: str | Column) -> Column:
    """Mask values under sensitive keys; redact the text of the others."""
    return F.transform_values(
        col(m),
        lambda k, v: F.when(v.isNotNull() & k.rlike(SENSITIVE_KEY_ONLY), F.lit(fixed.MASK)).otherwise(redact_text(v)),
    )


# Our own specification of the secret scan, most specific pattern first:
# (kind, pattern, group that holds the value, confidence).
# Fixed values:
_Q = r"""\s*(?:=>|=|:)\s*["'`]"""
_V = r"""([^"'`\n]{4,}+)["'`]"""
SECRET_PATTERNS = [
    ("DISCORD_WEBHOOK", r"(?i)(https?://(?:[a-z0-9-]+\.)?discord(?:app)?\.com/api/(?:v\d+/)?webhooks/[\w-]+/[\w-]+)", 1, 0.9),
    ("PRIVATE_KEY", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----)", 1, 0.9),
    ("JWT", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 0.9),
    ("DISCORD_BOT_TOKEN", r"([A-Za-z0-9_-]{23,28}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,40})", 1, 0.9),
    ("URI_CREDENTIALS", r"""(?i)(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s:/@"']+:([^\s@"'/]+)@""", 1, 0.9),
    ("AUTHORIZATION_HEADER", r"""(?i)authorization\s*+[:=]\s*+["']?\s*+(?:bearer|basic|token)\s++([\w.~+/=-]{8,})""", 1, 0.9),
    ("GENERIC_WEBHOOK", r"""(?i)(https?://[^\s"'`]*/webhooks?/[A-Za-z0-9_\-/]{16,})""", 1, 0.9),
    ("LICENCE_KEY", r"(?i)licen[cs]e[_-]?key" + _Q + _V, 1, 0.7),
    ("PASSWORD", r"(?i)(?:password|passwd|pwd|db[_-]?pass)" + _Q + _V, 1, 0.7),
    ("API_KEY", r"(?i)(?:api[_-]?key|access[_-]?key|auth[_-]?token|secret|token)" + _Q + _V, 1, 0.7),
]
WEBHOOK_KINDS = ["DISCORD_WEBHOOK", "GENERIC_WEBHOOK"]
PLACEHOLDER = r"(?i)example|placeholder|change[_-]?me|your[_-]|x{4,}|dummy|sample|<[^>]*>|todo"
PLACEHOLDER_CONFIDENCE = 0.25
LOW_VARIETY = 6
LOW_VARIETY_PENALTY = 0.2


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per secret: kind, line, column, confidence, masked value, excerpt.

    The raw value never leaves the function. Matches are taken in the order of
    their kinds; one that overlaps a match taken before is dropped. All of it happens inside one line's row: no shuffle.
    """
    from ..functions import mask_secret

    rows = (
        docs.where(F.col(text).rlike(MAYBE_SECRET))
        .select(key, F.posexplode(lines(text)).alias("_pos", "_line"))
        .where(F.col("_line").rlike(MAYBE_SECRET))
    )
    found = F.concat(*[_matches(rank, *p) for rank, p in enumerate(SECRET_PATTERNS)])
    rows = rows.withColumn("_all", F.array_sort(found))  # by rank
    clear = lambda kept, m: ~F.exists(kept, lambda o: (o["lo"] < m["hi"]) & (m["lo"] < o["hi"]))
    rows = rows.withColumn(
        "_kept",
        F.aggregate("_all", F.filter("_all", lambda m: F.lit(False)), lambda kept, m: F.when(clear(kept, m), F.array_append(kept, m)).otherwise(kept)),
    )
    # every value found in the line is masked in its excerpt, also those of dropped matches, longest first
    values = F.array_sort(F.array_distinct(F.transform("_all", lambda m: F.struct((-F.length(m["value"])).alias("n"), m["value"].alias("value")))))
    masked = F.aggregate(values, F.col("_line"), lambda line, v: F.replace(line, v["value"], F.lit(fixed.MASK)))
    # the outer form, as a test for empty lists would be pushed below and find all matches again, several times
    hits = rows.select(key, "_pos", F.explode_outer("_kept").alias("m"), masked.alias("_line")).where(F.col("m").isNotNull())
    value = F.col("m.value")
    variety = F.size(F.array_distinct(F.split(value, "")))
    confidence = F.when(value.rlike(PLACEHOLDER), F.lit(PLACEHOLDER_CONFIDENCE)).otherwise(
        F.col("m.confidence") - F.when(variety < LOW_VARIETY, F.lit(LOW_VARIETY_PENALTY)).otherwise(F.lit(0.0))
    )
    return hits.select(
        key,
        F.col("m.kind").alias("kind"),
        (F.col("_pos") + 1).cast("bigint").alias("line"),
        F.col("m.lo").cast("bigint").alias("column"),
        js_round(confidence, 2).alias("confidence"),
        mask_secret(value).alias("masked_value"),
        redact_text("_line").alias("redacted_excerpt"),
    )


def _matches(rank: int, kind: str, pattern: str, group: int, confidence: float) -> Column:
    """Array of a pattern's matches in `_line` with their extent.

    Extents follow from the pieces between the matches.
    """
    line = F.col("_line")
    whole = F.regexp_extract_all(line, F.lit(_outer(pattern)), 1)
    values = F.regexp_extract_all(line, F.lit(pattern), group)
    pieces = F.split(line, pattern)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(whole)),
        lambda k: F.struct(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            F.lit(confidence).alias("confidence"),
            F.element_at(values, k).alias("value"),
            (F.lit(1) + _total(F.slice(pieces, 1, k)) + _total(F.slice(whole, 1, k - 1))).alias("lo"),
            (F.lit(1) + _total(F.slice(pieces, 1, k)) + _total(F.slice(whole, 1, k))).alias("hi"),
        ),
    )
    return F.when(line.rlike(pattern), ends).otherwise(F.array().cast(_MATCH_TYPE))


_MATCH_TYPE = (
    "array<struct<rank:int,kind:string,confidence:double,value:string,lo:int,hi:int>>"
)


def _outer(pattern: str) -> str:
    """The pattern with one more group around all of it."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}({pattern[len(flag):]})"


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))


def secret_findings(secrets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings of the secret and webhook rules; weak matches are LOW."""
    from ..functions import finding_id

    hook = F.col("kind").isin(WEBHOOK_KINDS)
    rule = F.when(hook, "SEC-WEBHOOK-001").otherwise("SEC-SECRET-001")
    where = F.concat_ws(":", "kind", F.col("line").cast("string"), F.col("column").cast("string"))
    return secrets.select(
        finding_id(rule, F.lit(""), F.col(key).cast("string"), "line", where).alias("id"),
        rule.alias("rule_id"),
        F.when(F.col("confidence") < 0.4, "LOW").when(hook, "MEDIUM").otherwise("HIGH").alias("severity"),
        "confidence",
        key,
        "line",
    )


# Obfuscation patterns. String literals end on their own line.
# Loops are possessive: nothing to give back, and no recursion in Java.
STRING_LITERAL = r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
BASE64_LITERAL = r"""^["'][A-Za-z0-9+/]{32,}={0,2}["']$"""
ESCAPED_LITERAL = r"(?:\\(?:\d{1,3}|x[0-9a-fA-F]{2})){8}"
NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
OPAQUE_NAME = r"^(?:_0x[0-9a-f]+|[Il1O0]{6,}|[a-zA-Z]{1,2}\d{4,})$"
DECODE_CALL = (
    "(?i)" + fixed.NB
    + "(?:FromBase64|from_base64|base64Decode|b64decode|DecodeString|Decrypt|Inflate|Decompress)" + fixed.NA
)
LOAD_CALL = fixed.NB + r"(?:load|loadstring|RunString|dofile)\s*\("
CHAR_CALL = r"string\.char\s*\("
KEYWORDS = (
    "and break do else elseif end false for function goto if in local nil not or repeat return then true until while"
).split()


def obfuscation_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts behind the six indicators, by regular expressions over whole texts."""
    t = F.col(text)
    strings = F.regexp_extract_all(t, F.lit(STRING_LITERAL), 1)
    outside = F.regexp_replace(t, STRING_LITERAL, " ")
    names = F.filter(F.regexp_extract_all(outside, F.lit(NAME), 1), lambda n: ~n.isin(KEYWORDS))
    return (
        docs.select(key, t.alias("_t"), strings.alias("_s"), names.alias("_n"))
        .select(
            key,
            F.size("_s").cast("bigint").alias("strings"),
            F.size(F.filter("_s", lambda s: s.rlike(BASE64_LITERAL))).cast("bigint").alias("encoded_strings"),
            F.size(F.filter("_s", lambda s: s.rlike(ESCAPED_LITERAL))).cast("bigint").alias("escaped_strings"),
            (F.col("_t").rlike(DECODE_CALL) & F.col("_t").rlike(LOAD_CALL)).alias("decode_chain"),
            F.regexp_count("_t", F.lit(CHAR_CALL)).cast("bigint").alias("char_calls"),
            F.size(F.filter(lines("_t"), lambda x: F.length(x) > 2000)).cast("bigint").alias("long_lines"),
            F.size("_n").cast("bigint").alias("names"),
            F.size(F.filter("_n", lambda n: n.rlike(OPAQUE_NAME))).cast("bigint").alias("opaque_names"),
        )
    )


def obfuscation_score(features: DataFrame, encoded_ratio: float = 0.25, min_strings: int = 8) -> DataFrame:
    """Indicator flags, their weighted sum (at most 1) and the finding confidence."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    flags = {
        "DECODE_CHAIN": F.col("decode_chain"),
        "ENCODED_STRING_DENSITY": (F.col("strings") >= min_strings) & (share("encoded_strings", "strings") >= encoded_ratio),
        "OPAQUE_IDENTIFIERS": (F.col("names") >= 20) & (share("opaque_names", "names") >= 0.4),
        "CHARACTER_RECONSTRUCTION": F.col("char_calls") >= 5,
        "ESCAPED_STRING_DENSITY": F.col("escaped_strings") >= 3,
        "LONG_SINGLE_LINE": F.col("long_lines") > 0,
    }
    total = reduce(
        lambda a, b: a + b,
        [F.when(flag, F.lit(fixed.OBFUSCATION_WEIGHTS[k])).otherwise(F.lit(0.0)) for k, flag in flags.items()],
    )
    indicators = F.array_compact(F.array(*[F.when(flag, F.lit(k)) for k, flag in flags.items()]))
    raw = F.least(F.lit(1.0), total)
    score = js_round(raw, 2)
    return (
        features.withColumn("indicators", indicators)
        .withColumn("score", score)
        # tolerance: binary sums such as .2 + .1 must not miss the limit
        .withColumn("reportable", raw >= 0.3 - 1e-12)
        .withColumn("confidence", F.when(F.col("reportable"), js_round(F.least(F.lit(0.85), 0.4 + F.col("score") * 0.5), 2)))
    )
