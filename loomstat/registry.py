"""Name of a query -> the function that builds it, and its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("frame", "metrics", "ranking", "relational", "neighbours", "selection", "splits", "learning", "generative", "optimization", "search", "crystals", "streams", "tuned", "trees", "kernels", "designs")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name; sql says the same where SQL can."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"loomstat.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
