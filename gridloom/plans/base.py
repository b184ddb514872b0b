"""Tables of the driver, and the registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """t.events reads events.parquet of the folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Registers a function of the tables; sql is what DuckDB must return too."""

        def of(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            key = name or f.__name__
            self.queries[key] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[key] = sql
            return f

        return of
