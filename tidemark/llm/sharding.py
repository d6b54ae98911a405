"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by a 64-bit key: 32 bits of the text's hash, then 32 bits of the id's hash, so
equal texts lie side by side. A sample drawn in proportion to size gives quantiles of the key,
which split the rows into ranges of nearly equal bytes, many more than there are shards. A range
that still holds too much is split at quantiles of its own, and so are its parts, as often as needed; what then holds one key
only (rows alike in text and id) is cut into pieces, so no range outgrows a task. A window inside
each range and the sums of the ranges before it give a row's place in the whole order, hence its
shard and its slot. The driver holds at most ``MOST_RANGES`` keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.fingerprint import named
from tidemark.llm.common import row_hash, saved

OVERHEAD = 16
#: First ranges per shard, at most so many in all, and sample keys for each.
RANGES_PER_SHARD, MOST_RANGES, SAMPLES = 8, 4096, 32
#: A range or part beyond either is split again, into so many parts.
RANGE_ROWS, RANGE_BYTES, PARTS = 1 << 19, 1 << 28, 64
#: Equal texts stay together if they are at most this part of a shard.
WHOLE = 0.04
_HIGH = -(1 << 32)


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long")


def order_key(text: Column, id_: Column) -> Column:
    high = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(_HIGH))
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(3), id_.cast("string")), 32))


def _group_edges(splitters: np.ndarray) -> np.ndarray:
    """Splitters moved to the start of their group of equal texts, unless a neighbour lies in it too."""
    high = splitters & _HIGH
    alone = np.ones(len(high), bool)
    alone[1:] &= high[1:] != high[:-1]
    alone[:-1] &= high[:-1] != high[1:]
    return np.where(alone, high, splitters)


def _splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Keys that split ``rows`` into about ``ranges`` ranges of equal size."""
    if not total:
        return np.empty(0, np.int64)
    # a row is drawn SAMPLES * ranges * size / total times on average, decided by its own hash
    rate = F.col("size") * F.lit(float(SAMPLES * ranges)) / F.lit(float(total))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(5), "key", "tie"), 11) / F.lit(float(1 << 53))
    times = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")
    drawn = rows.select("key", F.explode(F.array_repeat(F.lit(0), times)))
    found = drawn.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    return _group_edges(np.array(found or [], dtype=np.int64))


def _assign(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            found = pa.array(np.searchsorted(splitters, keys, "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "range"])

    return run


_UNIT = ["range", "part"]


def _value() -> Column:
    """What a part is split by: groups of equal texts, or ids in a part that is one group. Quantiles are exact for numbers of 32 bits."""
    return F.when(F.col("one_group"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.shiftright("key", 32))


def _parted(rows: DataFrame, splits: Sequence[DataFrame]) -> DataFrame:
    """``rows`` with ``part``, by the stored splits of each round."""
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    for own in splits:
        below = F.coalesce(F.size(F.filter("at", lambda x: x <= _value())), F.lit(0))
        rows = rows.join(own, _UNIT, "left").withColumn("part", F.col("part") * PARTS + below).drop("at", "one_group")
    return rows


def _splits(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The splits of ranges that hold too much, and of their parts, until none but those of one key holds too much; and how many pieces these
    are cut into. ``rows`` need only ``range``, ``key`` and ``size``."""
    overfull = (F.col("n") > RANGE_ROWS) | (F.col("bytes") > RANGE_BYTES)
    one_group = F.shiftright("a", 32) == F.shiftright("b", 32)
    splits: list[DataFrame] = []
    while True:
        parted = _parted(rows, splits)
        held = parted.groupBy(*_UNIT).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b"))
        pieces = F.greatest(F.ceil(F.col("n") / RANGE_ROWS), F.ceil(F.col("bytes") / RANGE_BYTES))
        over = saved(held.where(overfull).select(*_UNIT, one_group.alias("one_group"), (F.col("a") == F.col("b")).alias("one_key"), pieces.alias("pieces")), "shard-overfull")
        if over.where("NOT one_key").isEmpty():
            return splits, over.select(*_UNIT, "pieces")
        at = F.percentile_approx(_value(), [k / PARTS for k in range(1, PARTS)], 100 * PARTS)
        many = over.where("NOT one_key").select(*_UNIT, "one_group")
        own = parted.join(many, _UNIT).groupBy(*_UNIT, "one_group").agg(at.alias("at"), F.min(_value()).alias("least"))
        # a value that is several quantiles, or the least, is a part by itself
        again = lambda x, i: (F.coalesce(F.get("at", i - 1) == x, F.lit(False)) | (x == F.col("least"))).cast("long")
        splits.append(saved(own.select(*_UNIT, "one_group", F.transform("at", lambda x, i: x + again(x, i)).alias("at")), "shard-parts"))


def _in_units(rows: DataFrame, splits: Sequence[DataFrame], pieces: DataFrame) -> DataFrame:
    """``rows`` with ``part`` and ``piece``. A part of one key is cut without regard to order: its rows are alike."""
    rows = _parted(rows, splits).join(pieces, _UNIT, "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("pieces"))).otherwise(0)
    return rows.withColumn("piece", piece.cast("int")).drop("pieces")


def place(docs: DataFrame, shards: int, id_col: str, text: str, carry: Sequence[str], stored: bool = False) -> DataFrame:
    """The ``carry`` columns of ``docs`` as a struct ``row``, with ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``stored`` writes the keyed rows once, which pays when the carried columns are narrow; else only their keys are, and the rows are read again
    when it is known where they go."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct(*(named(c) for c in carry)).alias("row"),
        size_of(F.col(text)).alias("size"),
        F.crc32(value).alias("text_crc32"),
        order_key(F.col(text), F.col(id_col)).alias("key"),
        row_hash(docs).alias("tie"),
    )
    if stored:
        rows = saved(rows, "shard-keys")
    # where rows go is found on their keys alone
    keys = rows.select("key", "size", "tie") if stored else saved(rows.select("key", "size", "tie"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = _splitters(keys, total, min(MOST_RANGES, shards * RANGES_PER_SHARD))
    ranged = lambda df: df.mapInArrow(_assign(splitters), StructType([*df.schema.fields, StructField("range", IntegerType())]))
    rows = _in_units(ranged(rows), *_splits(ranged(keys)))
    unit = ["range", "part", "piece"]
    ordered = Window.partitionBy(*unit).orderBy("high", "key", "tie")
    group = Window.partitionBy(*unit, "high")
    rows = rows.withColumn("high", F.shiftright("key", 32)).select(
        "*",
        (F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.row_number().over(ordered) - 1).cast("long").alias("number"),
    )
    rows = rows.select("*", F.sum("size").over(group).alias("group_size"), F.min("before").over(group).alias("group_before"))
    rows = saved(rows.drop("key", "tie", "high"), "shard-ranges")
    units = rows.groupBy(*unit).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = units.select(*unit, F.coalesce(F.sum("bytes").over(earlier), zero).alias("bytes_at"), F.coalesce(F.sum("n").over(earlier), zero).alias("rows_at"))
    rows = rows.join(saved(offsets, "shard-offsets"), unit)
    whole = F.col("group_size") <= F.lit(WHOLE * total / shards)
    middle = F.when(whole, F.col("group_before") + F.col("group_size") / 2).otherwise(F.col("before") + F.col("size") / 2)
    shard = F.least(F.floor((F.col("bytes_at") + middle) * shards / F.lit(float(max(total, 1)))).cast("int"), F.lit(shards - 1))
    rows = rows.select("row", "size", "text_crc32", shard.alias("shard"), (F.col("rows_at") + F.col("number")).alias("at"))
    first = saved(rows.groupBy("shard").agg(F.min("at").alias("first")), "shard-firsts")
    # one row per shard: ``shards`` bounds it
    return rows.join(F.broadcast(first), "shard").select("row", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes and ``OVERHEAD``), ``text_crc32``, ``shard`` and
    ``slot`` (gapless from 0 in each shard). Shards have nearly equal bytes.

    A null text is empty, a null id is an id like others. Rows alike in every column may swap
    slots. An empty table gives no rows, fewer rows than shards leave shards empty, and one
    text larger than a shard makes its shard larger. Other columns only break ties."""
    return place(docs, shards, id_col, text, [id_col], stored=True).select("row.*", "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which replace columns of these names."""
    carry = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return place(docs, shards, id_col, text, carry).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet, one folder per shard."""
    shard_documents(docs, shards, id_col, text).write.partitionBy("shard").parquet(path)
