"""Filters of fixed size over keys: which rows certainly have no partner, told without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 2 MB in at most 512 rows, however many keys went in.
BITS = 1 << 24


def _spot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def key_filter(rows: DataFrame, key: Column) -> DataFrame:
    """(filter_bucket, filter_bits): a bit for every hashed key of `rows`, combined on the map side."""
    return rows.groupBy(F.bitmap_bucket_number(_spot(key)).alias("filter_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_spot(key))).alias("filter_bits")
    )


def may_match(rows: DataFrame, key: Column, keys: DataFrame, name: str = "may_match") -> DataFrame:
    """`rows` with a flag that is false only where the key is not among those of the filter `keys`.

    The filter may be broadcast because its size does not depend on its input.
    """
    position = F.bitmap_bit_position(_spot(key))
    byte = F.conv(F.hex(F.substring(F.col("filter_bits"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("filter_bucket", F.bitmap_bucket_number(_spot(key)))
        .join(F.broadcast(keys), "filter_bucket", "left")
        .withColumn(name, F.coalesce(F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False)))
        .drop("filter_bucket", "filter_bits")
    )
