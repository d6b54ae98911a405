"""Options for reading an operational database through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.typemap import MAX_PRECISION


@dataclass(frozen=True)
class JdbcTable:
    url: str
    table: str
    driver: str | None = None
    fetch_rows: int = 10_000
    query: str | None = None
    partition_column: str | None = None
    partitions: int = 1
    #: What the database appends to a table to read a part of it, such as ``TABLESAMPLE (1 PERCENT)``; empty to rank all rows.
    sample: str = ""
    #: A whole-number expression that divides the rows of one very frequent value, such as a second key column.
    spread: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)

    @property
    def relation(self) -> str:
        return f"({self.query}) q" if self.query else self.table


def base_options(source: JdbcTable) -> dict[str, str]:
    """Date-times arrive without a zone, as the source's clock wrote them."""
    options = {
        "url": source.url, "fetchsize": str(source.fetch_rows), "preferTimestampNTZ": "true", **source.properties
    }
    if source.driver:
        options["driver"] = source.driver
    return options


def bounds_query(source: JdbcTable) -> str:
    c = source.partition_column
    return f"(SELECT MIN({c}) AS low, MAX({c}) AS high FROM {source.relation}) b"


def greatest_query(source: JdbcTable, column: str, as_number: bool = False) -> str:
    value = f"CAST({column} AS DECIMAL(38, 0))" if as_number else column
    return f"(SELECT MAX({value}) AS high FROM {source.relation}) m"


def greatest(spark: SparkSession, source: JdbcTable, column: str) -> object:
    """The column's greatest value, found by the database instead of by a scan; numbers that are kept as text are compared as numbers."""
    reader = spark.read.format("jdbc").options(**base_options(source))
    kinds = {f.name.lower(): f.dataType for f in reader.option("dbtable", source.relation).load().schema}
    as_number = isinstance(kinds.get(column.lower()), T.StringType)
    return reader.option("dbtable", greatest_query(source, column, as_number)).load().first()[0]


def measure_query(source: JdbcTable, column: str | None, condition: str | None = None) -> str:
    newest = f"MAX({column})" if column else "NULL"
    where = f" WHERE {condition}" if condition else ""
    return f"(SELECT COUNT(*) AS n, {newest} AS newest FROM {source.relation}{where}) m"


def measured(spark: SparkSession, source: JdbcTable, column: str | None, condition: str | None = None) -> tuple[int, str | None]:
    """Row count and greatest watermark, at second precision, found by the database instead of by a scan."""
    row = spark.read.format("jdbc").options(**base_options(source), dbtable=measure_query(source, column, condition)).load().first()
    newest = row[1]
    return int(row[0]), f"{newest:%Y-%m-%d %H:%M:%S}" if isinstance(newest, datetime) else None if newest is None else str(newest)


def read_options(
    source: JdbcTable, column_type: T.DataType | None = None, low: int | None = None, high: int | None = None
) -> dict[str, str]:
    """Parallel range read on a whole-number column; anything else is read by one task."""
    options = {**base_options(source), "dbtable": source.relation}
    ranged = isinstance(column_type, T.IntegralType) or (
        isinstance(column_type, T.DecimalType) and column_type.scale == 0
    )
    if source.partition_column and ranged and source.partitions > 1 and low is not None and high is not None:
        options.update(
            partitionColumn=source.partition_column,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(source.partitions),
        )
    return options


#: Tiles that are asked for each partition: a value that fills several is frequent.
TILES = 8


def depth_query(source: JdbcTable) -> str:
    """The lowest value and the rows of equally many ranked rows each, found by the database: one row per tile."""
    c, tiles = source.partition_column, source.partitions * TILES
    ranked = f"SELECT {c} AS v, NTILE({tiles}) OVER (ORDER BY {c}) AS tile FROM {source.relation} {source.sample} WHERE {c} IS NOT NULL"
    return f"(SELECT tile, MIN(v) AS low, MAX(v) AS high, COUNT(*) AS n FROM ({ranked}) t GROUP BY tile) d"


def _sql_value(value: object) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def depth_predicates(source: JdbcTable, tiles: Sequence[tuple[object, object, int]]) -> list[str]:
    """Conditions that split a table into about ``partitions`` parts of equal rows: every row meets one of them.

    ``tiles`` are (low, high, rows). A value that fills whole tiles has parts of its own, divided by ``spread``; ranges
    take the other tiles until they hold their share. ``tiles`` come in the database's order, and bounds compare as the database compares them, so any type
    with an order will do. Rows without a value come with the first part."""
    c = source.partition_column
    total = sum(n for _, _, n in tiles)
    share = max(1, total / source.partitions)
    frequent: dict[object, int] = {}
    for low, high, n in tiles:
        if low == high:
            frequent[low] = frequent.get(low, 0) + n
    frequent = {v: n for v, n in frequent.items() if n >= share}
    starts, held = [], 0.0
    for low, high, n in tiles:
        if low == high and low in frequent:
            continue
        if held + n > share and held:
            if not starts or starts[-1] != low:
                starts.append(low)
            held = 0.0
        held += n
    ranges = []
    for i in range(len(starts) + 1):
        ends = ([f"{c} >= {_sql_value(starts[i - 1])}"] if i else []) + ([f"{c} < {_sql_value(starts[i])}"] if i < len(starts) else [])
        ranges.append(" AND ".join(ends) or f"{c} IS NOT NULL")
    if frequent:
        others = f"{c} NOT IN ({', '.join(map(_sql_value, frequent))})"
        ranges = [f"{r} AND {others}" for r in ranges]
    ranges[0] = f"({ranges[0]}) OR {c} IS NULL"
    for value, n in frequent.items():
        parts = max(1, round(n / share)) if source.spread else 1
        same = f"{c} = {_sql_value(value)}"
        if parts == 1:
            ranges.append(same)
            continue
        spread = f"MOD(ABS({source.spread}), {parts})"
        ranges += [f"{same} AND {spread} = {i}" for i in range(1, parts)] + [f"{same} AND ({spread} = 0 OR {source.spread} IS NULL)"]
    return ranges


def custom_schema(precisions: Mapping[str, int]) -> str:
    """``customSchema`` text that reads over-wide decimals as text."""
    return ", ".join(f"{name} STRING" for name, p in precisions.items() if p > MAX_PRECISION)


def read_table(
    spark: SparkSession, source: JdbcTable, precisions: Mapping[str, int] | None = None, equal_depth: bool = True
) -> DataFrame:
    """A table or query, in parallel if it has a partition column: in ranges of equally many rows, whatever the column's type and
    however its values lie. Without ``equal_depth`` a whole-number column is cut into ranges of equal width, which
    needs its ends only."""
    options = {**base_options(source), "dbtable": source.relation}
    extra = custom_schema(precisions or {})
    if extra:
        options["customSchema"] = extra
    plain = spark.read.format("jdbc").options(**options).load()
    if not source.partition_column or source.partitions <= 1:
        return plain
    if equal_depth:
        tiles = spark.read.format("jdbc").options(**base_options(source), dbtable=depth_query(source)).load().collect()
        if not tiles:
            return plain
        properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        # in the database's own order of values
        ordered = [(t[1], t[2], int(t[3])) for t in sorted(tiles, key=lambda t: t[0])]
        return spark.read.jdbc(source.url, source.relation, predicates=depth_predicates(source, ordered), properties=properties)
    names = {f.name.lower(): f.dataType for f in plain.schema}
    kind = names.get(source.partition_column.lower())
    ends = spark.read.format("jdbc").options(**base_options(source), dbtable=bounds_query(source)).load().first()
    ranged = read_options(source, kind, ends[0], ends[1])
    if extra:
        ranged["customSchema"] = extra
    return spark.read.format("jdbc").options(**ranged).load()
