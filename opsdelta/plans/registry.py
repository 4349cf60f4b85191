"""The list of queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, small_parts
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `sql` may use the views by name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(small_parts(prepare(spark)), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


# SQL text of the shared scalars, for the oracles.


def r6(x: str) -> str:
    return f"(floor(({x})::DOUBLE * 1000000 + 0.5) / 1000000)"


def jsr(x: str, digits: int = 0) -> str:
    k = 10**digits
    return f"(floor(({x})::DOUBLE * {k} + 0.5) / {k})"


def txt(x: str, digits: int) -> str:
    return f"cast(cast({jsr(x, digits)} as DECIMAL(28,{digits})) as VARCHAR)"


def pct(x: str) -> str:
    return (
        f"(case when ({x}) is null or isinf({x}) or isnan({x}) then 'not comparable' "
        f"else (case when ({x}) > 0 then '+' else '' end) || {txt(f'({x})*100', 2)} || '%' end)"
    )


def duration(ms: str) -> str:
    s = jsr(f"({ms}) / 1000.0::DOUBLE")
    m = jsr(f"{s} / 60.0::DOUBLE")
    return (
        f"(case when {s} < 60 then {s}::BIGINT || 's' when {m} < 60 then {m}::BIGINT || 'm' "
        f"else {txt(f'{m} / 60.0::DOUBLE', 1)} || 'h' end)"
    )


def iso_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def hid(prefix: str, *parts: str) -> str:
    text = " || ' ' || ".join(f"coalesce(cast({p} as VARCHAR), '')" for p in parts)
    return f"('{prefix}_' || substr(sha256({text}), 1, 16))"


def fnd(rule: str, resource: str, file: str, line: str, disc: str) -> str:
    return hid("fnd", rule, resource, file, f"coalesce(cast({line} as VARCHAR), '-1')", disc)


def lanes(part: str) -> str:
    sums = " || ':' || ".join(
        f"coalesce(sum(('0x' || substr(sha256({part}), {1 + 7 * i}, 7))::BIGINT), 0)::VARCHAR" for i in range(9)
    )
    return f"sha256({sums})"


def rank_sql(severity: str) -> str:
    return (
        f"(case {severity} when 'INFO' then 0 when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 "
        f"when 'CRITICAL' then 4 end)"
    )
