"""Expiry, cascade deletes and storage counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cascade  # noqa: F401  (part of this module's surface)


def cutoff(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def expired(ts: str, now: Column, days: int) -> Column:
    """Strictly older than the cutoff; zero or fewer days keep everything."""
    if days <= 0:
        return F.lit(False)
    return F.col(ts) < cutoff(now, days)


def leaves(df: DataFrame, ts: str, now: Column, days: int, server: str | None = None, everything: bool = False) -> Column:
    """Whether a row goes: by age or, with `everything`, whatever its age; of one server only, if named.

    A table that knows no servers loses nothing to a purge of one server.
    """
    gone = F.lit(True) if everything else F.coalesce(expired(ts, now, days), F.lit(False))
    if server is None:
        return gone
    return gone & F.coalesce(F.col("server_id") == server, F.lit(False)) if "server_id" in df.columns else F.lit(False)


def purge(df: DataFrame, ts: str, now: Column, days: int, server: str | None = None, everything: bool = False) -> DataFrame:
    """What remains. Rows without a time are kept, but for a purge of everything."""
    return df.where(~leaves(df, ts, now, days, server, everything))


def purge_counts(tables: dict[str, tuple[DataFrame, str, int]], now: Column, server: str | None = None, everything: bool = False) -> DataFrame:
    """Dry run: how many rows each table would lose."""
    parts = [
        df.agg(F.count_if(leaves(df, ts, now, days, server, everything)).alias("deleted"), F.count(F.lit(1)).alias("total")).select(
            F.lit(name).alias("table_name"), "deleted", (F.col("total") - F.col("deleted")).alias("kept")
        )
        for name, (df, ts, days) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def storage_usage(tables: dict[str, DataFrame], server: str | None = None) -> DataFrame:
    """Row counts per table, of one server where the table knows servers."""
    def scoped(df: DataFrame) -> DataFrame:
        return df.where(F.col("server_id") == server) if server and "server_id" in df.columns else df

    parts = [
        scoped(df).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
