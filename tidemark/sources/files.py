"""Reading files: declared formats, dump text, name patterns, lineage, bad records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.values import ZERO_DATES, strict_columns
from tidemark.sources.zstd import read_lines

CORRUPT, SOURCE = "_corrupt_record", "_source_file"
# The escapes a tab-separated dump uses after a backslash.
DUMP_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\0", "\0"), ("\\b", "\b"), ("\\Z", "\x1a"))
DUMP_NULL = "\\N"


@dataclass(frozen=True)
class FileFormat:
    """A declared file format. ``extras`` are reader options used as they are. A record that does not
    fit the schema ends the load, unless ``extras`` names another ``mode``."""

    kind: str = "CSV"  # CSV, PARQUET, JSON
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    skip_header: int = 0
    multiline: bool = False
    extras: Mapping[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        if self.kind != "CSV":
            return {**({"mode": "FAILFAST"} if self.kind == "JSON" else {}), **self.extras}
        return {
            "sep": self.delimiter,
            "quote": self.quote,
            "escape": self.escape,
            "header": "true" if self.skip_header == 1 else "false",
            "enforceSchema": "true",
            "multiLine": str(self.multiline).lower(),
            "mode": "FAILFAST",
            **self.extras,
        }


def read_declared(
    spark: SparkSession, path: str, fmt: FileFormat, schema: T.StructType | str | None = None
) -> DataFrame:
    if fmt.kind == "CSV" and fmt.skip_header > 1:
        return read_after_lines(spark, path, fmt, schema).drop(SOURCE)
    reader = spark.read.options(**fmt.options())
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt.kind == "CSV":
        reader = reader.option("inferSchema", "true")
    return reader.format(fmt.kind.lower()).load(path)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: FileFormat | None = None, extra_fields: str = "ignore"
) -> DataFrame:
    """Quoted CSV where an empty field, quoted or not, is null and rows may be ragged: a short row lacks values, and fields past the
    last column are ignored or, with ``extra_fields="fail"``, end the load. Fields are read as text and must then fit their types."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fmt = fmt or FileFormat()
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    # the parser fails on a row of more fields than it has room for
    room = {"maxColumns": str(len(text.fields))} if extra_fields == "fail" else {}
    rows = read_declared(spark, path, replace(fmt, extras={"mode": "PERMISSIVE", **room, **fmt.extras}), text)
    return strict_columns(rows, [(f.name, F.nullif(F.col(f"`{f.name}`"), F.lit("")), f.dataType) for f in wanted.fields])


def read_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet matched to a schema by name without regard to case; absent columns are null."""
    return spark.read.schema(schema).parquet(path)


def _dump_field(raw: Column) -> Column:
    """Undo backslash escapes: split at escaped backslashes, decode the pieces, rejoin."""

    def decode(piece: Column) -> Column:
        for escape, char in DUMP_ESCAPES:
            piece = F.replace(piece, F.lit(escape), F.lit(char))
        return F.regexp_replace(piece, r"\\(.)", "$1")

    decoded = F.array_join(F.transform(F.split(raw, r"\\\\", -1), decode), "\\")
    text = F.when(F.contains(raw, F.lit("\\")), decoded).otherwise(raw)
    return F.when(~raw.isin(DUMP_NULL, *ZERO_DATES), text)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, rejects: bool = False) -> DataFrame:
    """Tab-separated dump: ``\\N`` and zero dates are null, empty text stays empty.

    Raw tabs and line ends are escaped by the writer, so plain lines can be split
    across tasks. Fields that a line lacks are null. A line with more fields, or a value that does not fit
    its type, ends the load; with ``rejects`` such lines come with nulls and their text in ``_corrupt_record``.
    Files named ``.zst`` are unpacked while they are read, those with an index of frames by several tasks."""
    return tsv_rows(_dump_lines(spark, path), schema, rejects)


def tsv_rows(lines: DataFrame, schema: T.StructType, rejects: bool = False) -> DataFrame:
    """Dump lines, in the column ``value``, as rows."""
    fields = F.split("value", "\t", -1)
    n, kinds = len(schema.fields), schema.fields
    if not rejects:
        counted = F.when(F.size(fields) <= n, fields).otherwise(F.raise_error(F.concat(F.lit(f"more than {n} fields: "), "value")).cast("array<string>"))
        got = lines.select(counted.alias("f"))
        return strict_columns(got, [(f.name, _dump_field(F.get("f", F.lit(i))), f.dataType) for i, f in enumerate(kinds)])
    raw = lines.select("value", *[_dump_field(F.get(fields, F.lit(i))).alias(f"t{i}") for i in range(n)], (F.size(fields) > n).alias("odd"))
    cast = [F.col(f"t{i}").try_cast(f.dataType) for i, f in enumerate(kinds)]
    bad = F.col("odd")
    for i, c in enumerate(cast):
        bad = bad | (F.col(f"t{i}").isNotNull() & c.isNull())
    return raw.select(*[c.alias(f.name) for c, f in zip(cast, kinds)], F.when(bad, F.col("value")).alias(CORRUPT))


def _dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a dump, packed or not."""
    packed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.zst").load(path)
    names = [r.path for r in packed.select("path").collect()]  # one per packed file
    plain = spark.read.text(path, lineSep="\n")
    if not names:
        return plain
    others = plain.where(~F.endswith(F.col("_metadata.file_path"), F.lit(".zst"))).select("value")
    return read_lines(spark, names).unionByName(others)


def tsv_line(df: DataFrame) -> Column:
    """The dump line for a row, the inverse of ``read_tsv``."""

    def encode(field: T.StructField) -> Column:
        text = F.replace(F.col(field.name).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for escape, char in DUMP_ESCAPES:
            text = F.replace(text, F.lit(char), F.lit(escape))
        return F.coalesce(text, F.lit(DUMP_NULL))

    return F.concat_ws("\t", *[encode(f) for f in df.schema.fields])


def _line_skipper(count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops the first lines of each file. Lines reach a task in file order, so what is left to drop
    of the file last seen is all the state; batches without a file's start pass as they are."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, left = None, 0
        for batch in batches:
            names = batch.column("path").dictionary_encode() if batch.num_rows else None
            if names is None:
                continue
            codes = names.indices.to_numpy()
            begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            ends = np.append(begins[1:], batch.num_rows)
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in zip(begins.tolist(), ends.tolist()):
                name = names.dictionary[int(codes[lo])].as_py()
                if name != path:
                    path, left = name, count if batch.column("start")[lo].as_py() == 0 else 0
                keep[lo : min(hi, lo + left)] = False
                left -= min(hi - lo, left)
            kept = batch if keep.all() else batch.filter(pa.array(keep))
            yield kept.select(["value", "path"])

    return drop


def read_after_lines(spark: SparkSession, path: str, fmt: FileFormat, schema: T.StructType | str, pattern: str | None = None) -> DataFrame:
    """Skip the first lines of each file where they lie: in the split that starts it. The file's path
    comes along as ``SOURCE``."""
    if schema is None:
        raise ValueError("skipping more than one line needs a schema")
    reader = spark.read.options(**{k: v for k, v in fmt.extras.items() if k == "recursiveFileLookup"})
    lines = reader.text(path)
    if pattern is not None:
        lines = lines.where(F.col("_metadata.file_path").rlike(pattern))
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    body = lines.mapInArrow(_line_skipper(fmt.skip_header), "value string, path string")
    ddl = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
    )
    options = {k: v for k, v in fmt.options().items() if k not in ("header", "multiLine", "enforceSchema", "recursiveFileLookup")}
    return body.select(F.from_csv("value", ddl, options).alias("r"), F.col("path").alias(SOURCE)).select("r.*", SOURCE)


def read_matching(reader: Callable[[SparkSession], DataFrame], spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of the files whose path matches a regex.

    The condition is on file metadata only, so other files are never opened."""
    return reader(spark).where(F.col("_metadata.file_path").rlike(pattern))


def with_source_file(df: DataFrame, name: str = "_src_file", full_path: bool = True) -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path" if full_path else "_metadata.file_name"))


def dated_path(base: str, run_date: date | None) -> str:
    """The run date's folder below a base path, or the base itself."""
    root = base.rstrip("/") + "/"
    return f"{root}{run_date:%Y%m%d}/" if run_date else root


def load_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The source, or None when there is nothing to load: no path or no rows."""
    try:
        rows = read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if rows.isEmpty() else rows


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str, fmt: FileFormat) -> DataFrame:
    """The first bad record ends the whole load."""
    return spark.read.schema(schema).options(**{**fmt.options(), "mode": "FAILFAST"}).format(fmt.kind.lower()).load(path)


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, fmt: FileFormat) -> DataFrame:
    """Every record, with the text of the bad ones in ``_corrupt_record``.

    Save the result before asking which are bad: the reader parses only the columns a
    query names."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**fmt.options(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.schema(wide).options(**options).format(fmt.kind.lower()).load(path)


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as a small table: one row per column."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")
