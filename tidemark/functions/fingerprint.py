"""Row fingerprints and the order-independent table hash built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Both sides of a comparison must write rows the same way.
NULL_TOKEN = "~N~"
SEPARATOR = "~|~"
HASH_HEX_DIGITS = 15


def named(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def canonical_text(field: T.StructField, float_as: str = "decimal(18,2)") -> Column:
    """One value as text: second precision for times, fixed scale for floats."""
    value, kind = named(field.name), field.dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.DateType):
        text = F.date_format(value, "yyyy-MM-dd")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # values past the fixed scale's range keep their own text
        text = F.coalesce(value.try_cast(float_as).cast("string"), value.cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.hex(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_TOKEN))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    names = list(columns or df.columns)
    return F.concat_ws(SEPARATOR, *[canonical_text(df.schema[n]) for n in names])


def row_slice(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The leading 60 bits of the row text's MD5 as a whole number."""
    return F.conv(F.substring(F.md5(row_text(df, columns)), 1, HASH_HEX_DIGITS), 16, 10).cast("long")


def exact_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """64 bits of a row's values at full precision. Which values are null is hashed as well, since
    nulls leave a hash as it was; columns without an order of values are hashed as JSON."""
    values = [comparable(df.schema[n]) for n in columns]
    absent = F.concat(F.lit("n"), *[named(n).isNull().cast("int").cast("string") for n in columns])
    return F.xxhash64(*values, absent)


def _unordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def comparable(field: T.StructField) -> Column:
    """A column that can be ordered and hashed: maps by their sorted entries, what holds maps or
    variants as JSON."""
    value = named(field.name)
    if isinstance(field.dataType, T.MapType) and not _unordered(field.dataType.valueType):
        return F.array_sort(F.map_entries(value))
    return F.to_json(F.struct(value.alias("v"))) if _unordered(field.dataType) else value


def with_slices(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str | Column] = ()) -> DataFrame:
    """Row slices and the columns still needed. Computed in a projection of its own:
    inside the aggregate the generated code grows too long to be compiled well."""
    return df.select(row_slice(df, columns).alias("_slice"), *keep)


def table_hash() -> Column:
    """Aggregate over ``_slice``: XOR of all row slices as text, "0" for an empty table.

    XOR cancels pairs of equal rows, so compare row counts beside it.
    """
    return F.coalesce(F.bit_xor("_slice"), F.lit(0)).cast("string")
