"""One entry per query: a function over named tables, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from poledger.sources import bridge


class Tables:
    """Named tables of one data directory, each planned once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = bridge.table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def lazy(self, name: str) -> DataFrame:
        """A bridge table of which few columns are read, once."""
        return bridge.lazy(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a query. `sql` is DuckDB SQL over driver, bridge and `views` tables."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(fn, bridge.with_clause(sql, views) if sql else None)
        return fn

    return wrap
