"""Helpers that several operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.fingerprint import comparable, named
from tidemark.session import work_path

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \u0009\u000a\u000b\u000c\u000d"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed there.
    Functions that are made after this call carry the setting."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here, and the
    reread table has a known size, so Spark broadcasts it only if it is small."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored keys of at most so many rows (some tens of megabytes) are broadcast.
BROADCAST_ROWS = 500_000


def small_side(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow keys for one side of a join: counted, and broadcast if it is small, so
    that the texts on the other side stay where they are; beyond that an ordinary join."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns as one struct, whatever their names and types."""
    return F.struct(*(named(c) for c in df.columns if c.lower() not in but))


def row_hash(df: DataFrame, *seed: Column) -> Column:
    """64 bits of all columns; maps and variants are hashed as what can be compared of them."""
    return F.xxhash64(*seed, *(comparable(f) for f in df.schema))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def digest60(value: Column) -> Column:
    """60 bits of the MD5 of a value's text, as a long; null counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
