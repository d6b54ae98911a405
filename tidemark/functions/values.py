"""Small value expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# What the dump formats use for "no date".
ZERO_DATES = ("0000-00-00", "0000-00-00 00:00:00")


def ntz(value: str | datetime) -> Column:
    """Timestamp literal without time zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def literal_for(df: DataFrame, column: str, value: object) -> Column:
    """Literal in the column's own type, so the comparison can be pushed down."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def time_ceiling(as_of: str | datetime, lag_minutes: int = 1) -> datetime:
    """Upper bound of a time window: the source clock minus a safety lag."""
    clock = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)
    return clock - timedelta(minutes=lag_minutes)


def strict_cast(column: Column, to: str | T.DataType, where: str = "a value") -> Column:
    """A cast that ends the query on a value that does not fit, whatever the session's ANSI setting."""
    kind = to if isinstance(to, str) else to.simpleString()
    text = F.concat(F.lit(f"{where} is no {kind}: "), column.cast("string"))
    done = column.try_cast(to)
    return F.when(done.isNull() & column.isNotNull(), F.raise_error(text).cast(to)).otherwise(done)


def strict_columns(df: DataFrame, wanted: list[tuple[str, Column, T.DataType]]) -> DataFrame:
    """(name, text, type) as columns of those types; a text that does not fit ends the query. Each text is worked out and cast once, in
    projections of their own, and then only looked at."""
    texts = df.select([text.alias(f"_t{i}") for i, (_, text, _) in enumerate(wanted)])
    cast = texts.select("*", *[F.col(f"_t{i}").try_cast(kind).alias(f"_c{i}") for i, (_, _, kind) in enumerate(wanted) if not isinstance(kind, T.StringType)])
    out = []
    for i, (name, _, kind) in enumerate(wanted):
        value, done = F.col(f"_t{i}"), F.col(f"_c{i}")
        told = F.concat(F.lit(f"{name} is no {kind.simpleString()}: "), value)
        bad = F.raise_error(told).cast(kind)
        out.append((value if isinstance(kind, T.StringType) else F.when(done.isNull() & value.isNotNull(), bad).otherwise(done)).alias(name))
    return cast.select(out)


def zero_date_to_null(column: Column, to: str = "date") -> Column:
    """Zero dates become null; any other text must be a date."""
    text = column.cast("string")
    return strict_cast(F.when(~text.isin(*ZERO_DATES), text), to, "a date")


def trimmed_text(column: Column) -> Column:
    return F.trim(column.cast("string"))


def csv_quoted(column: Column) -> Column:
    """Null becomes empty, quotes are doubled, the value is wrapped in quotes."""
    body = F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), body, F.lit('"'))


def clock_text(column: Column) -> Column:
    """Date-time as written by the source clock, microseconds kept."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def second_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def mentions(term: str, *columns: str) -> Column:
    """Case-insensitive search over several columns, taken literally."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(term.lower())), F.lit(False))
    return found


def freshness(last_sync: Column, as_of: Column) -> Column:
    """"12m ago", "3.5h ago", "2.1d ago" or "Never"."""
    minutes = F.timestamp_diff("SECOND", last_sync, as_of) / F.lit(60)
    hours = minutes / 60

    def one_decimal(x: Column) -> Column:
        return F.round(x.cast("decimal(18,6)"), 1).cast("decimal(18,1)").cast("string")

    return (
        F.when(last_sync.isNull(), "Never")
        .when(hours < 1, F.concat(F.floor(minutes).cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(one_decimal(hours), F.lit("h ago")))
        .otherwise(F.concat(one_decimal(hours / 24), F.lit("d ago")))
    )


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType))
