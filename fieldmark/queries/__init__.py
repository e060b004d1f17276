"""Named queries over the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(Tables) -> DataFrame under name."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return wrap


def load() -> None:
    from . import aggregates, filters, joins, pipelines, ratings, readmodels, scalars, scans, streams, topk, windows  # noqa: F401
