"""Tables and the registration of a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (t, spark), t being a reader of tables."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(lambda x: table(spark, d, x), spark)
        if sql:
            ORACLES[name] = sql
        return f

    return add
