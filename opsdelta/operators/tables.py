"""Upsert, replace and cascade delete as joins over whole tables.

Plain Parquet has no merge. Each function returns the new table content; write
it to a staging path and swap, never over the path it is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], keep_first: list[str] = (), update: list[str] | None = None) -> DataFrame:
    """Insert or update by `key`.

    On a match the incoming value wins, but for `keep_first` columns and, when
    `update` is given, for every column it does not name.
    """
    e = existing.select(F.struct(*existing.columns).alias("e"), *key)
    i = incoming.select(F.struct(*existing.columns).alias("i"), *key)
    both = e.join(i, key, "full_outer")
    cols = []
    for c in existing.columns:
        old, new = F.col(f"e.{c}"), F.col(f"i.{c}")
        if c in key:
            cols.append(F.coalesce(old, new).alias(c))
            continue
        refreshed = c not in keep_first and (update is None or c in update)
        winner = F.when(F.col("i").isNotNull(), new).otherwise(old)
        kept = F.when(F.col("e").isNotNull(), old).otherwise(new)
        cols.append((winner if refreshed else kept).alias(c))
    return both.select(*cols)


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Drop every existing row of the keys that arrive, then add what arrives."""
    arriving = incoming.select(*key).distinct()
    return existing.join(arriving, key, "left_anti").unionByName(incoming)


def cascade(child: DataFrame, removed: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child rows that remain when parents are removed."""
    gone = removed.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(gone, child_key, "left_anti")
