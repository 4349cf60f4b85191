"""Fill-in-the-middle form of whole texts, cut at units of white space and what follows it.

A unit is a run of white space (space, tab to carriage return) with the run of other
characters after it, or a last run of white space. Of a text of n units two borders
a <= b between 0 and n are drawn from a hash of the id, and one match of a pattern
made for that row, whose counted groups take a and then b - a units possessively,
captures prefix, middle and suffix and sets them in their new order. Possessive counts
never step back, so a match takes one pass and no stack however long the text is.

A text stays plain if it is empty, holds a marker, or is not drawn. Markers are
unlike each other and no text with one is cut, so the parts of an output can be told
again: `restore` undoes every form.

A null text counts as empty. A null id hashes as no digits. Rows that repeat an id draw
the same numbers, each from its own n. Empty tables are fine; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, narrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE, _OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNIT = f"{_SPACE}*+{_OTHER}++|{_SPACE}++"
_MARKER = "<[PSM]>"


def draws(key: Column, seed: int, n: int) -> list[Column]:
    """The first `n` groups of eight hexadecimal digits of a hash of `seed:key`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars) of every row.

    Of a hundred texts about `rate` are cut, and `spm_rate` of a hundred of those put the suffix first.
    """
    text = F.col("text")
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed, 4)
    whole = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= rate)
    base = narrow(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    counted = base.select("doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"))
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    drawn = counted.select(
        "*",
        F.when(whole, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
        F.least(x, y).alias("a"),
        F.abs(x - y).alias("between"),
    )
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*+)\z", "a", "between")
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    out = drawn.select("doc_id", "n", "form", F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order)).alias("output"))
    cut = F.when(F.col("form") != "plain", _parts())
    split = out.select("*", cut.alias("parts"))
    return split.select(
        "doc_id", "n", "form", "output",
        F.length(_part("prefix")).cast("long").alias("prefix_chars"), F.length(F.col("parts")[3]).cast("long").alias("middle_chars"),
    )


def _parts() -> Column:
    """Nothing, then the three parts in the order of the form."""
    return F.split("output", _MARKER, -1)


def _part(name: str) -> Column:
    first, second = F.col("parts")[1], F.col("parts")[2]
    spm = F.col("form") == "spm"
    return F.when(spm, second).otherwise(first) if name == "prefix" else F.when(spm, first).otherwise(second)


def restore(df: DataFrame) -> DataFrame:
    """`df` with `restored`, the text that `form` and `output` came from."""
    parted = df.withColumn("parts", F.when(F.col("form") != "plain", _parts()))
    joined = F.concat(_part("prefix"), F.col("parts")[3], _part("suffix"))
    return parted.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(joined)).drop("parts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(documents(spark, sf_dir)))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
with hashed as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
drawn as (
  select doc_id, t, u, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as x, ('0x' || h[9:16])::bigint % (len(u) + 1) as y,
         ('0x' || h[17:24])::bigint % 100 as h3, ('0x' || h[25:32])::bigint % 100 as h4 from hashed),
cut as (
  select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 50 then 'plain' when h4 < 80 then 'spm' else 'psm' end as form,
         array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(u[greatest(x, y) + 1:], '') as s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256 from cut
"""
