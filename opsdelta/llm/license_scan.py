"""Licence notices by diagonal voting over word k-grams.

Every rolling pair of a document's words is hashed and joined to the positions at
which a template has that pair. A match at document word p and template word t lies
on diagonal p - t; matches are aggregated by document, template and diagonal.
Neighbouring diagonals (a word more or less in the text) are merged, and a span is
verified by the share of the template's pairs that it holds, compared as words and
not as hashes. The three base phrases need every pair on a single diagonal, which
means that their words stand consecutively.

All of it is one pass of DataFrame operators: only the templates, which are fixed
values of this module, are broadcast, and documents shrink to a row each before
anything is shuffled.

Null and empty texts have no words. Repeated rows (also of one doc_id) each get
their own result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, narrow

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that the method recognises besides, also with words changed. At most 64 words each.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Diagonals this far apart are one span.
GAP = 2
#: The least share of a notice's pairs in a verified span.
COVERAGE = 0.75

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """A row per pair of words: (template, label, base, n_pairs, at, left_word, right_word)."""
    rows = []
    for n, (label, text, base) in enumerate([(v, k, True) for k, v in BASE.items()] + [(a, b, False) for a, b in notices]):
        words = re.findall(_WORD, text)
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a template needs 2 to 64 words: {text}")
        rows += [(n, label, base, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_pairs int, at int, left_word string, right_word string")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] = NOTICES, gap: int = GAP, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): a row per input row, and a row per verified span of words.

    documents: doc_key, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    spans: doc_key, doc_id, label, base, first_word, end_word (exclusive), share.
    """
    found = _spans(df, id_col, text_col, notices, gap)
    good = F.col("share") >= F.when(F.col("base"), 1.0).otherwise(coverage)
    start = F.when(good & F.col("base"), F.col("first_word"))
    joined = lambda ok: F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",")
    docs = found.groupBy("doc_key", "doc_id", "n_words").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        joined(good & F.col("base")).alias("base_labels"),
        joined(good).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return docs, found.where(good).select("doc_key", "doc_id", "label", "base", "first_word", "end_word", "share")


def _spans(df: DataFrame, id_col: str, text_col: str, notices: list[tuple[str, str]], gap: int) -> DataFrame:
    """Candidate spans with the share of their template; a document without any has one row of nulls."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    docs = (
        narrow(df, doc_id=id_col, text=text_col)
        .select(F.monotonically_increasing_id().alias("doc_key"), "doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
        .withColumn("n_words", F.size("words").cast("long"))
    )
    pairs = docs.select("doc_key", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.col("n_words") - 1, F.lit(0)).cast("int")).alias("b"))).alias("p", "pair"))
    gram = pairs.select("doc_key", "doc_id", "n_words", "p", F.col("pair.a").alias("raw_left"), F.col("pair.b").alias("raw_right"))
    hashed = gram.withColumn("gram", F.xxhash64(F.lower("raw_left"), F.lower("raw_right")))
    places = F.broadcast(templates(df.sparkSession, notices).withColumn("gram", F.xxhash64("left_word", "right_word")))
    plain = F.concat("raw_left", "raw_right").rlike("^[0-9A-Za-z]+$")  # lower() may turn other letters into a-z
    same = (hashed["gram"] == places["gram"]) & (F.lower("raw_left") == F.col("left_word")) & (F.lower("raw_right") == F.col("right_word")) & plain
    keys = ["doc_key", "doc_id", "n_words", "template"]
    votes = (
        hashed.join(places, same, "left")
        .groupBy(*keys, (F.col("p") - F.col("at")).alias("diagonal"), "label", "base", "n_pairs")
        .agg(F.bit_or(_power("at")).alias("seen"), F.min(F.when(F.col("at").isNotNull(), F.col("p"))).alias("low"), F.max(F.when(F.col("at").isNotNull(), F.col("p"))).alias("high"))
    )
    along = Window.partitionBy("doc_key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > gap), F.lit(True))
    return (
        votes.withColumn("cluster", F.sum(fresh.cast("int")).over(along))
        .groupBy(*keys, "cluster", "label", "base", "n_pairs")
        .agg(F.bit_or("seen").alias("seen"), F.min("low").cast("long").alias("first_word"), (F.max("high") + 2).cast("long").alias("end_word"))
        .withColumn("share", F.bit_count("seen") / F.col("n_pairs"))
    )


def _power(column: str) -> Column:
    """2 to the column, as a long; null stays null."""
    return F.expr(f"shiftleft(1L, {column})")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))[0].drop("doc_key")
