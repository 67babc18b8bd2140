"""Named queries: a plan over a data directory and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.session import importable
from .views import duckdb_sql, view

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


class Tables:
    """Views and driver tables as attributes, bound to a session and a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        importable(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register ``f(tables) -> DataFrame`` under a name; ``raw``: the SQL is in DuckDB's dialect with its views."""

    def register(f):
        PLANS[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql if raw else duckdb_sql(sql)
        return f

    return register
