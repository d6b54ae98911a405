"""The operators' registered queries and, where plain SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import importable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return run(spark, sf_dir)

        QUERIES[name] = ready
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add
