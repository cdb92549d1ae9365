"""Named queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.graph import durable

Query = Callable[[SparkSession, str], DataFrame]
PLANS = ("cohort", "scans", "projections", "joins", "aggregates", "windows", "matching", "representation", "scoring", "inference", "learners", "repair", "spatial", "streams")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one directory; t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query uses more than once: made and written at its first use, read at all."""
        if name not in self._made:
            self._made[name] = durable(make())
        return self._made[name]


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables as a query, with its DuckDB SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"cohortspark.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
