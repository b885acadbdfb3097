"""The registered queries: a function of (spark, sf_dir) each, with equivalent SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; `sql` runs over the same tables and returns the same rows."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        _queries[name] = run
        if sql:
            _sql[name] = sql
        return f

    return add


def registered_sql(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def _load() -> None:
    for module in ("market", "macro", "texts", "records", "training", "stores", "streams"):
        importlib.import_module(f"tidemark.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def sql() -> dict[str, str]:
    _load()
    return dict(_sql)
