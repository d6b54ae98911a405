"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

from tidemark.queries.registry import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, Decimal):
        return value.normalize() if value else Decimal(0)
    return value


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both hold the same columns and rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == expected:
        return ""
    return (
        f"rows {sum(got.values())} vs {sum(expected.values())}; "
        f"only spark {list((got - expected).items())[:2]}; only sql {list((expected - got).items())[:2]}"
    )
