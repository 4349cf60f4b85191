"""Runs a registered query and its SQL twin and compares the two as bags of rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int = 8, partitions: int = 8):
    from opsdelta.session import build_session

    spark = build_session(
        "opsdelta-tests",
        f"local[{cores}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=str(partitions),
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = bag([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    for name, a, b in zip(got_cols, *[list(zip(*x[:50])) or [()] * len(got_cols) for x in (got, want)]):
        ta, tb = ({type(v) for v in s if v is not None} for s in (a, b))
        if ta and tb and ta != tb:
            return f"types of {name}: {ta} != {tb}"
    if len(got) != len(want):
        only = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
        return f"rows {len(got)} != {len(want)} {only}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ {bad[:2]}"
    return None
