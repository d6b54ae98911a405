"""Source metadata as tables: discovery, column order, index membership."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Schemas that belong to the database itself.
MYSQL_SYSTEM = ("information_schema", "performance_schema", "mysql", "sys")
TERADATA_SYSTEM = (
    "DBC", "CRASHDUMPS", "DBCMNGR", "EXTERNAL_AP", "EXTUSER",
    "LOCKLOGSHREDDER", "QCD", "SQLJ", "SYS_CALENDAR", "SYSADMIN",
    "SYSBAR", "SYSJDBC", "SYSLIB", "SYSSPATIAL", "SYSTEMFE",
    "SYSUDTLIB", "SYSUIF", "TD_SERVER_DB", "TD_SYSFNLIB",
    "TD_SYSGPL", "TD_SYSXML", "TDPUSER", "TDQCD", "TDSTATS",
    "TDWM", "DEFAULT",
)
SYSTEM_SCHEMAS = tuple(sorted({s.upper() for s in MYSQL_SYSTEM + TERADATA_SYSTEM}))


def user_tables(tables: DataFrame) -> DataFrame:
    """Base tables outside system schemas, from ``(schema_name, table_name, table_type)``."""
    return tables.where(
        (F.col("table_type") == "BASE TABLE") & ~F.upper("schema_name").isin(*SYSTEM_SCHEMAS)
    ).select("schema_name", "table_name")


def user_schemas(schemas: DataFrame) -> DataFrame:
    """Schema names that are not the database's own."""
    return schemas.select("schema_name").where(~F.upper("schema_name").isin(*SYSTEM_SCHEMAS)).distinct()


def catalog_tables(spark: SparkSession, schema: str) -> DataFrame:
    """Tables the session's catalog lists for a schema."""
    return spark.sql("SHOW TABLES IN IDENTIFIER(:s)", args={"s": schema}).where(~F.col("isTemporary")).select(
        F.col("namespace").alias("schema_name"), F.col("tableName").alias("table_name")
    )


def column_ordinals(
    columns: DataFrame, table_keys: Sequence[str], order: str, then: Sequence[str] = (), span: int = 4096
) -> DataFrame:
    """Position of each column inside its table, by a whole-number ``order`` column.

    Rows are numbered inside blocks of ``span`` ids, and a block starts where the counts
    of the blocks before it end. However many rows one table has, a task numbers a block
    of them."""
    block = [*table_keys, "_block"]
    rows = columns.withColumn("_block", F.floor(F.col(order) / span))
    before = Window.partitionBy(*table_keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(
        *block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*[F.col(f"r.{c}") for c in block]).orderBy(*[F.col(f"r.{c}") for c in (order, *then)])
    same = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in block])
    ordinal = F.col("s._start") + F.row_number().over(inside)
    return rows.alias("r").join(starts.alias("s"), same).select(
        *[F.col(f"r.{c}") for c in columns.columns], ordinal.alias("ordinal")
    )


def with_indexes(columns: DataFrame, indexes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every column with the indexes it takes part in, or nulls."""
    return columns.join(indexes, list(keys), "left")
