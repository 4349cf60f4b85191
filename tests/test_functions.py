from pyspark.sql import functions as F

from opsdelta.functions import (
    classify_file, confidence_band, deterministic_id, finding_id, fingerprint, format_duration, format_percentage,
    glob_to_regex, js_round, mask_secret, normalize_confidence, relative_change, set_digest, severity_rank,
)


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_rounding_is_half_up_on_the_binary_double(spark):
    got = one(spark, js_round(F.lit(1.005), 2), js_round(F.lit(-2.5)), js_round(F.lit(2.5)), js_round(F.lit(0.495), 2))
    assert got == (1.0, -2.0, 3.0, 0.5)


def test_relative_change_of_a_zero_base(spark):
    c = relative_change
    assert one(spark, c(F.lit(0.0), F.lit(0.0)), c(F.lit(0.0), F.lit(3.0)), c(F.lit(2.0), F.lit(3.0))) == (0.0, float("inf"), 0.5)


def test_percentages(spark):
    f = lambda x: format_percentage(F.lit(x))
    assert one(spark, f(0.12341), f(-0.01), f(0.0), f(float("inf")), f(float("nan"))) == (
        "+12.34%", "-1.00%", "0.00%", "not comparable", "not comparable",
    )


def test_durations_round_at_each_step(spark):
    f = lambda ms: format_duration(F.lit(ms))
    assert one(spark, f(59_499), f(59_500), f(3_569_499), f(3_569_500), f(5_400_000)) == ("59s", "1m", "59m", "1.0h", "1.5h")


def test_ids_keep_the_place_of_absent_parts(spark):
    n = F.lit(None).cast("string")
    ids = one(
        spark, finding_id(F.lit("R"), n, F.lit("f"), n, F.lit("d")), deterministic_id("fnd", F.lit("R"), F.lit(""), F.lit("f"), F.lit("-1"), F.lit("d"))
    )
    assert ids[0] == ids[1] and len(ids[0]) == 20


def test_fingerprint_sorts_and_an_empty_list_is_the_empty_hash(spark):
    a = F.array(F.lit("b"), F.lit("a"))
    b = F.array(F.lit("a"), F.lit("b"))
    empty = F.array().cast("array<string>")
    x, y, z, w = one(spark, fingerprint(a), fingerprint(b), fingerprint(empty), F.sha2(F.lit("a b "), 256))
    assert x == y == w and z == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_set_digest_ignores_order_and_partitioning_but_not_copies(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("p"))
    d = lambda x: x.agg(set_digest("p")).first()[0]
    assert d(df) == d(df.repartition(7).orderBy(F.rand(1))) != d(df.union(df.limit(1)))
    assert d(df.limit(0)) is not None


def test_confidence(spark):
    n = lambda x: normalize_confidence(F.lit(x))
    b = lambda x: confidence_band(F.lit(x))
    assert one(spark, n(1.7), n(-0.2), n(0.494), n(0.495), n(float("nan"))) == (1.0, 0.0, 0.49, 0.5, None)
    assert one(spark, b(0.9), b(0.75), b(0.5), b(0.25), b(0.2)) == ("VERY_HIGH", "HIGH", "MODERATE", "LOW", "VERY_LOW")
    assert one(spark, severity_rank(F.lit("CRITICAL")), severity_rank(F.lit("nope"))) == (4, None)


def test_globs(spark):
    cases = [
        ("*.lua", "a.lua", True), ("*.lua", "x/a.lua", False), ("**/*.lua", "a.lua", True), ("**/*.lua", "x/y/a.lua", True),
        ("x/**", "x/y/z", True), ("a?.js", "ab.js", True), ("a?.js", "a/.js", False), ("a.b", "aXb", False),
        ("c\\*.lua", "c/q.lua", True), ("(x)+*", "(x)+1", True),
    ]
    df = spark.createDataFrame(cases, "g string, p string, want boolean").withColumn("re", glob_to_regex("g"))
    wrong = df.where(F.expr("p rlike re") != F.col("want")).collect()
    assert wrong == []


def test_files_and_masks(spark):
    assert one(spark, *[classify_file(F.lit(p)) for p in ("a/b.LUA", "x.ts", "noext", "a.b/c", "q.weird")]) == (
        "lua", "javascript", "unknown", "unknown", "weird",
    )
    assert one(spark, mask_secret(F.lit("abcdefgh")), mask_secret(F.lit("abc")), mask_secret(F.lit("a" * 40))) == (
        "ab********", "********", "aaaa********",
    )


def test_rounding_of_large_numbers(spark):
    from pyspark.sql import functions as F

    from opsdelta.functions import js_round
    from opsdelta.functions.scalars import fixed_text

    values = [1.5e15, 9.3e18, -4e22, 123456.5, -0.5, 2.5, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", js_round("x", 4).alias("a"), js_round("x").alias("b"), fixed_text(F.col("x"), 2).alias("t"))
    rows = {r["x"]: r for r in df.collect()}
    assert all(rows[v]["a"] == v for v in (1.5e15, 9.3e18, -4e22, float("inf"))) and rows[1.5e15]["t"] == "1500000000000000.00"
    assert (rows[2.5]["b"], rows[-0.5]["b"], rows[123456.5]["b"]) == (3.0, 0.0, 123457.0)
