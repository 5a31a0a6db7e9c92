"""Registered queries: one Spark plan per operator plus its DuckDB oracle text.

A query is ``fn(spark, sf_dir) -> DataFrame`` that reads the driver tables
(or views Spark derives from them) in full. The oracle is plain SQL over
the same tables; stand-in views are inlined as CTEs by ``oracle_with``.
Doubles are rounded to 6 places on both sides so the comparison is exact
on values and tolerant of last-bit differences between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.sources.views import oracle_with

ROUND_DIGITS = 6


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    round_cols: list[str] = field(default_factory=list)


REGISTRY: dict[str, Query] = {}


def _round_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), ROUND_DIGITS).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None, dbl: list[str] | None = None):
    """Decorator: ``dbl`` lists the DOUBLE output columns to round in the oracle."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, list(dbl or []))
        return fn
    return deco


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round_doubles(q.fn(spark, sf_dir))
    run.__name__ = name
    return run


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT. Rewrite to ``count(CASE ...)``."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _bigint_count_if(sql[j + len("count_if("):k - 1])
        out.append(f"count(CASE WHEN {inner} THEN 1 END)")
        i = k


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    body = oracle_with(_bigint_count_if(q.sql))
    if not q.round_cols:
        return body
    repl = ", ".join(f"round({c}, {ROUND_DIGITS}) AS {c}" for c in q.round_cols)
    return f"SELECT * REPLACE ({repl}) FROM ({body}) AS __q"


def load_all() -> None:
    """Import every catalogue module so their decorators run."""
    from sparkclin.plans import (  # noqa: F401
        catalog_io, catalog_quality, catalog_protect, catalog_features,
        catalog_model, catalog_metrics, catalog_rules, catalog_drift,
        catalog_monitor, catalog_balance,
    )
