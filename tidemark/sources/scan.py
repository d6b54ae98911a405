"""Table scans: whole, filtered, and the windows that read only what changed.

All of them return a lazy DataFrame whose predicates compare a bare column with a
literal of its own type, so Parquet and JDBC sources receive them as pushed filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.fingerprint import comparable
from tidemark.functions.values import literal_for, trimmed_text

# Cursors that stand for "nothing loaded yet".
FIRST_TIME = "1900-01-01 00:00:00"
FIRST_ID = 0


@dataclass(frozen=True)
class Scan:
    """What to read from one source table."""

    load_type: str = "FULL"  # FULL, FILTER, INCREMENTAL
    filter: str | None = None
    cursor_column: str | None = None
    cursor_type: str = "time"  # time or id
    change_columns: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    trim: bool = False


def full_scan(df: DataFrame, condition: str | None = None, trim: bool = False) -> DataFrame:
    rows = df.where(F.expr(condition)) if condition else df
    return rows.select([trimmed_text(F.col(c)).alias(c) for c in rows.columns]) if trim else rows


def newer_than(df: DataFrame, column: str, cursor: object) -> DataFrame:
    """Open window: rows strictly after the stored cursor."""
    return df.where(F.col(column) > literal_for(df, column, cursor))


def within(df: DataFrame, column: str, cursor: object, ceiling: object) -> DataFrame:
    """Bounded window ``(cursor, ceiling]``."""
    value = F.col(column)
    return df.where((value > literal_for(df, column, cursor)) & (value <= literal_for(df, column, ceiling)))


def cursor_value(df: DataFrame, column: str, cursor_type: str) -> Column:
    """A cursor column's values in the order of its kind: ids that are kept as text are numbers, and a text
    that is none ends the load. Other columns are compared as they are, which keeps filters pushable."""
    value = F.col(column)
    return value.cast("long") if cursor_type == "id" and isinstance(df.schema[column].dataType, T.StringType) else value


def cursor_literal(df: DataFrame, column: str, cursor_type: str, value: object) -> Column:
    if cursor_type == "id" and isinstance(df.schema[column].dataType, T.StringType):
        return F.lit(None if value is None else int(value)).cast("long")
    return F.lit(None if value is None else str(value)).cast(df.schema[column].dataType)


def past_cursor(df: DataFrame, column: str, cursor_type: str, cursor: object, ceiling: object | None = None) -> DataFrame:
    """Rows past a cursor of either kind, up to a ceiling if there is one."""
    value = cursor_value(df, column, cursor_type)
    rows = df.where(value > cursor_literal(df, column, cursor_type, cursor))
    return rows if ceiling is None else rows.where(value <= cursor_literal(df, column, cursor_type, ceiling))


def id_ceiling(df: DataFrame, key: str) -> DataFrame:
    """Greatest key now in the source, one row; empty sources give null."""
    return df.agg(F.max(key).alias("ceiling"))


def within_ids(df: DataFrame, key: str, cursor: int) -> DataFrame:
    """Ids after the cursor up to the source's greatest id, fixed before the read."""
    return df.where(
        (F.col(key) > literal_for(df, key, cursor)) & (F.col(key) <= id_ceiling(df, key).scalar())
    )


def changed_between(df: DataFrame, columns: Sequence[str], start: object, end: object) -> DataFrame:
    """Any change column inside ``[start, end)``; no columns means every row."""
    return df.where(
        _any([
            (F.col(c) >= literal_for(df, c, start)) & (F.col(c) < literal_for(df, c, end)) for c in columns
        ])
    )


def changed_after(df: DataFrame, columns: Sequence[str], start: object) -> DataFrame:
    """Any change column strictly after ``start``."""
    return df.where(_any([F.col(c) > literal_for(df, c, start) for c in columns]))


def id_changed_after(df: DataFrame, column: str, last: object) -> DataFrame:
    """Id window on a column that may hold the number as text.

    A column that is already a whole number is compared as it is, which keeps the
    filter pushable."""
    kind = df.schema[column].dataType
    value = F.col(column) if isinstance(kind, T.IntegralType) else F.col(column).cast("long")
    return df.where(value > F.lit(int(last)).cast("long"))


def first_run_cursor(cursor: Column, cursor_type: str) -> Column:
    """The stored cursor, or the sentinel that lets the first run read everything."""
    if cursor_type == "id":
        return F.coalesce(cursor.cast("long"), F.lit(FIRST_ID).cast("long"))
    return F.coalesce(cursor, F.lit(FIRST_TIME).cast("timestamp_ntz"))


def with_lookback(df: DataFrame, column: str, cursor: object, minutes: int, ceiling: object) -> DataFrame:
    """Re-read a tail before the cursor, so late rows are seen; an upsert absorbs repeats."""
    low = literal_for(df, column, cursor) - F.expr(f"INTERVAL {int(minutes)} MINUTE")
    return df.where((F.col(column) > low) & (F.col(column) <= literal_for(df, column, ceiling)))


def scan(
    df: DataFrame, spec: Scan, cursor: object | None = None, ceiling: object | None = None
) -> DataFrame:
    """Apply one table's scan settings. The static filter holds in every load type;
    a missing cursor reads everything up to the ceiling."""
    rows = df.where(F.expr(spec.filter)) if spec.filter else df
    if spec.load_type == "FILTER" and not spec.filter:
        raise ValueError("a FILTER scan needs a filter")
    if spec.load_type == "INCREMENTAL":
        start = cursor if cursor is not None else (FIRST_ID if spec.cursor_type == "id" else FIRST_TIME)
        if spec.change_columns and not (spec.cursor_type == "id" and spec.cursor_column):
            rows = (
                changed_between(rows, spec.change_columns, start, ceiling)
                if ceiling is not None
                else changed_after(rows, spec.change_columns, start)
            )
        elif spec.cursor_column:
            rows = past_cursor(rows, spec.cursor_column, spec.cursor_type, start, ceiling)
    if spec.columns:
        rows = rows.select(*spec.columns)
    return full_scan(rows, trim=spec.trim)


def ranged(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """Rows of a source that came in fewer partitions, spread over key ranges when the column is a whole
    number.

    Files that lie in enough splits, and other types, keep what the source gave. The row hash as second
    range column lets one repeated value spread over partitions."""
    if not isinstance(df.schema[column].dataType, T.IntegralType) or df.rdd.getNumPartitions() >= partitions:
        return df
    return df.repartitionByRange(partitions, F.col(column), F.xxhash64(*[comparable(f) for f in df.schema]))


def custom_sql(
    spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None, **window: object
) -> DataFrame:
    """A full SELECT in place of the generated scan.

    Tables are named ``{name}`` in the text; the window is bound as ``:extract_start``
    and ``:extract_end``, or written ``{extract_start_dttm}``/``{extract_end_dttm}``."""
    text = query.replace("{extract_start_dttm}", ":extract_start").replace("{extract_end_dttm}", ":extract_end")
    return spark.sql(text, args=dict(window) or None, **(tables or {}))


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(True)
