"""Projections that give a delta or a target its shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark.functions.typemap import MAX_PRECISION, spark_type_text
from tidemark.functions.values import clock_text, csv_quoted, strict_cast, trimmed_text

# The bookkeeping columns every target carries, and those of a history table.
AUDIT_SCHEMA = {
    "_load_ts": "timestamp_ntz",
    "_src_file": "string",
    "_batch_id": "string",
    "_is_deleted": "boolean",
    "_deleted_at": "timestamp_ntz",
}
HISTORY_SCHEMA = {
    "_valid_from": "timestamp_ntz",
    "_valid_to": "timestamp_ntz",
    "_is_current": "boolean",
}


def business_columns(df: DataFrame) -> list[str]:
    """Names that do not start with an underscore."""
    return [c for c in df.columns if not c.startswith("_")]


def with_audit(df: DataFrame, batch_ts: Column, batch_id: str, src_file: Column | None = None) -> DataFrame:
    """Business columns plus audit columns; a file name already on the rows is kept."""
    if src_file is None:
        src_file = F.col("_src_file") if "_src_file" in df.columns else F.lit(None)
    values = {
        "_load_ts": batch_ts,
        "_src_file": src_file,
        "_batch_id": F.lit(batch_id),
        "_is_deleted": F.lit(False),
        "_deleted_at": F.lit(None),
    }
    return df.select(
        *business_columns(df), *[values[n].cast(t).alias(n) for n, t in AUDIT_SCHEMA.items()]
    )


def with_history(df: DataFrame, batch_ts: Column) -> DataFrame:
    """An open validity interval that starts with the batch."""
    values = {"_valid_from": batch_ts, "_valid_to": F.lit(None), "_is_current": F.lit(True)}
    return df.withColumns({n: values[n].cast(t) for n, t in HISTORY_SCHEMA.items()})


def live_rows(df: DataFrame) -> DataFrame:
    """Rows not soft-deleted and, in a history table, current."""
    rows = df.where(~F.coalesce(F.col("_is_deleted"), F.lit(False)))
    return rows.where(F.col("_is_current")) if "_is_current" in df.columns else rows


def key_projection(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select([F.col(k).alias(k.upper()) for k in keys])


def positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The n-th column under the n-th name."""
    return df.toDF(*names)


def trim_all(df: DataFrame) -> DataFrame:
    return df.select([trimmed_text(F.col(c)).alias(c) for c in df.columns])


def quote_all(df: DataFrame) -> DataFrame:
    return df.select([csv_quoted(F.col(c)).alias(c) for c in df.columns])


def generic_columns(df: DataFrame) -> DataFrame:
    """Every output of a custom query as text under ``COLUMN_n``."""
    return df.select([F.col(c).cast("string").alias(f"COLUMN_{i}") for i, c in enumerate(df.columns, 1)])


def clock_columns(df: DataFrame) -> DataFrame:
    """Date-times as the source clock's text, so no zone shift can happen."""
    return df.select(
        [
            clock_text(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def wide_decimals_as_text(df: DataFrame, precisions: Mapping[str, int]) -> DataFrame:
    """Columns whose source precision is over the target's limit are carried as text."""
    return df.select(
        [
            F.col(c).cast("string").alias(c) if precisions.get(c, 0) > MAX_PRECISION else F.col(c)
            for c in df.columns
        ]
    )


def apply_schema(df: DataFrame, types: Mapping[str, str], bad: str = "fail") -> DataFrame:
    """Upper-case names and cast each column to its mapped type. A value that does not fit ends the
    load, or with ``bad="null"`` becomes null."""
    cast = {"fail": strict_cast, "null": lambda c, t: c.try_cast(t)}[bad]
    return df.select([(cast(F.col(c), types[c]) if c in types else F.col(c)).alias(c.upper()) for c in df.columns])


def target_struct(types: Mapping[str, str], history: bool = False) -> T.StructType:
    """Target schema: mapped business columns, audit columns, history columns."""
    fields = {c.upper(): t for c, t in types.items()}
    fields.update({c.upper(): t for c, t in AUDIT_SCHEMA.items()})
    if history:
        fields.update({c.upper(): t for c, t in HISTORY_SCHEMA.items()})
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items()))


def drift_report(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Per table: columns to add and columns gone from the source but kept.

    Inputs are ``(table_name, column_name)``. Both go through one grouping by name, which
    tasks reduce before the shuffle; no join."""

    def side(columns: DataFrame, name: str) -> DataFrame:
        return columns.select("table_name", F.upper("column_name").alias("column_name"), F.lit(name).alias("side"))

    own = target_columns.where(~F.startswith("column_name", F.lit("_")))
    seen = side(source_columns, "source").unionByName(side(own, "target")).groupBy("table_name", "column_name").agg(
        F.min("side").alias("first"), F.max("side").alias("last")
    )
    change = F.when(F.col("first") == "source", "added").otherwise("dropped")
    return seen.where(F.col("first") == F.col("last")).select("table_name", "column_name", change.alias("change"))


def widen(target: DataFrame, delta: DataFrame) -> DataFrame:
    """The target with the delta's new business columns as nulls; nothing is removed."""
    have = {c.lower() for c in target.columns}
    new = [f for f in delta.schema.fields if f.name.lower() not in have and not f.name.startswith("_")]
    return target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}) if new else target


def added_columns_ddl(table: str, target: T.StructType, source: T.StructType) -> list[str]:
    """``ALTER TABLE`` text for a catalog table that lacks source columns."""
    have = {f.name.lower() for f in target.fields}
    return [
        f"ALTER TABLE {table} ADD COLUMNS (`{f.name}` {f.dataType.simpleString()})"
        for f in source.fields
        if f.name.lower() not in have and not f.name.startswith("_")
    ]


def target_columns(mapped: DataFrame, history: bool = False) -> DataFrame:
    """Target schemas of a whole catalogue, one row per column.

    ``mapped``: ``(table_name, ordinal, column_name, target_type)``. The bookkeeping
    columns follow each table's own."""
    tail = {**AUDIT_SCHEMA, **(HISTORY_SCHEMA if history else {})}
    extra = F.array(
        *[
            F.struct(F.lit(i).alias("o"), F.lit(n.upper()).alias("column_name"), F.lit(t).alias("spark_type"))
            for i, (n, t) in enumerate(tail.items(), 1)
        ]
    )
    own = mapped.select(
        "table_name", "ordinal", F.upper("column_name").alias("column_name"),
        spark_type_text(F.col("target_type")).alias("spark_type"),
    )
    added = (
        mapped.groupBy("table_name")
        .agg(F.max("ordinal").alias("n"))
        .select("table_name", "n", F.explode(extra).alias("c"))
        .select("table_name", (F.col("n") + F.col("c.o")).alias("ordinal"), "c.column_name", "c.spark_type")
    )
    return own.unionByName(added)


class TypeChangeError(ValueError):
    """A column's type changed in a way that stored files cannot follow."""


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def holds(wide: T.DataType, narrow: T.DataType) -> bool:
    """Every value of ``narrow`` is one of ``wide``, and files of it can be read as ``wide``."""
    a, b = wide.simpleString(), narrow.simpleString()
    if a == b or b == "void":
        return True
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE.index(a) >= _WHOLE.index(b)
    if isinstance(wide, T.DecimalType) and isinstance(narrow, T.DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    return (a, b) in (("double", "float"), ("double", "int"), ("double", "smallint"), ("double", "tinyint"), ("timestamp_ntz", "date"))


def agree(stored: T.StructType, rows: DataFrame, keys: Sequence[str] = ()) -> tuple[T.StructType, DataFrame]:
    """The stored schema and the rows on common types: rows are cast to stored types that hold theirs,
    and a stored type gives way to a wider one. Any other change, and for keys any but of whole
    numbers, is refused: it needs a full load."""
    new = {f.name.lower(): f for f in rows.schema.fields}
    fields, casts = [], {}
    for f in stored.fields:
        other = new.get(f.name.lower())
        if other is None or other.dataType == f.dataType:
            fields.append(f)
            continue
        up, down = holds(f.dataType, other.dataType), holds(other.dataType, f.dataType)
        if not (up or down) or (f.name in keys and not {f.dataType.simpleString(), other.dataType.simpleString()} <= set(_WHOLE)):
            raise TypeChangeError(f"{f.name} is {f.dataType.simpleString()}, not {other.dataType.simpleString()}: load it in full")
        fields.append(f if up else T.StructField(f.name, other.dataType, True))
        if up:
            casts[other.name] = F.col(other.name).cast(f.dataType)
    return T.StructType(fields), rows.withColumns(casts) if casts else rows


def schema_changes(stored: T.StructType, source: T.StructType) -> str | None:
    """Added, dropped and changed business columns in words; null if there are none."""
    old = {f.name.lower(): f.dataType.simpleString() for f in stored.fields if not f.name.startswith("_")}
    new = {f.name.lower(): f.dataType.simpleString() for f in source.fields if not f.name.startswith("_")}
    words = [f"added {c} {new[c]}" for c in new if c not in old] + [f"dropped {c}" for c in old if c not in new]
    words += [f"{c} {old[c]} -> {new[c]}" for c in new if c in old and old[c] != new[c]]
    return "; ".join(words) or None
