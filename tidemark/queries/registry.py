"""The list of queries, and inputs derived from the given tables.

A derived input is one SELECT that Spark and a plain SQL engine both run, so both
sides of a comparison start from the same rows. Tables are named ``{table}``;
``{ntz}`` is the engine's timestamp without zone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries.inputs import INPUTS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()




def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fill(text: str, tables: dict[str, str], ntz: str, text_type: str) -> str:
    for name, value in tables.items():
        text = text.replace("{" + name + "}", value)
    return text.replace("{ntz}", ntz).replace("{text}", text_type)


def _needed(text: str) -> list[str]:
    """Derived inputs a text uses, each after those it is made from."""
    order: list[str] = []
    for name in INPUTS:
        if re.search(rf"\b{name}\b", text):
            order += [n for n in [*_needed(INPUTS[name]), name] if n not in order]
    return order


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input as a DataFrame. Nested inputs become common table expressions."""
    parts = [n for n in _needed(name)]
    files = {t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}
    ctes = ", ".join(f"{n} AS ({INPUTS[n]})" for n in parts)
    return spark.sql(_fill(f"WITH {ctes} SELECT * FROM {name}", files, "TIMESTAMP_NTZ", "STRING"))


def oracle(body: str) -> str:
    body = body.strip()
    parts = _needed(body)
    names = {t: t for t in TABLES}
    ctes = ", ".join(f"{n} AS ({INPUTS[n]})" for n in parts)
    if ctes:
        body = f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
    return _fill(body, names, "TIMESTAMP", "VARCHAR")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run

    return add
