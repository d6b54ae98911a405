"""A ledger of ids not seen yet below a cursor: rows committed late are read when they appear, without reading a tail again.

Databases hand out ids before they commit, so an id below the cursor may appear after the cursor has passed it. The ledger is a
set of spans of such ids, with the time each was first missed. Later runs probe the source for ids in these spans only. Ids are
compared in blocks, so no task holds more than a block of one span, however many ids a source has.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import ntz

BLOCK_BITS = 16
#: Blocks that all spans are cut into at most, as a power of two: sparser ids have larger blocks.
MOST_BLOCKS = 20
#: Spans of at most so many ids lists are asked for as a filter the source can use; more are joined.
PUSHED = 200
SPANS = "low bigint, high bigint, since timestamp_ntz"


def _block_bits(spans: DataFrame) -> int:
    """One number comes to the driver."""
    total = spans.agg(F.sum(F.col("high") - F.col("low") + 1).cast("decimal(38,0)")).first()[0]
    return max(BLOCK_BITS, int(total or 0).bit_length() - MOST_BLOCKS)


def _in_blocks(spans: DataFrame, bits: int) -> DataFrame:
    """Spans cut at block ends."""
    cut = spans.select("*", F.explode(F.sequence(F.shiftright("low", bits), F.shiftright("high", bits))).alias("block"))
    first = F.shiftleft(F.col("block"), bits)
    return cut.select("block", F.greatest("low", first).alias("low"), F.least("high", first + ((1 << bits) - 1)).alias("high"), "since")


def late_rows(source: DataFrame, value: Column, spans: DataFrame, cursor: int) -> DataFrame:
    """Source rows whose id (``value``, a whole number) lies in a span. Few spans are a filter on the scan; many are joined by block, after a filter
    on their ends."""
    some = spans.select("low", "high").limit(PUSHED + 1).collect()  # a bounded look
    if not some:
        return source.limit(0)
    if len(some) <= PUSHED:
        return source.where(reduce(or_, [value.between(s.low, s.high) for s in some]))
    least, bits = spans.agg(F.min("low")).first()[0], _block_bits(spans)
    rows = source.where(value.between(least, int(cursor))).select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("_row"), value.cast("long").alias("id"))
    met = _placed(rows.withColumn("block", F.shiftright("id", bits)), _in_blocks(spans, bits))
    return met.select(*[F.col("_row").getField(c).alias(c) for c in source.columns])


def _placed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows whose ``id`` lies in a span of their block, with the span's ``low``. The spans of a block don't overlap, so an id can only lie
    in the last one that begins at it or before: one pass over both in the order of ids, however many spans a block has."""
    both = rows.withColumns({"high": F.lit(None).cast("long"), "at": F.lit(1)}).unionByName(cut.select("block", F.col("low").alias("id"), "high", F.lit(0).alias("at")), True)
    last = F.struct(F.col("id").alias("low"), "high")
    before = Window.partitionBy("block").orderBy("id", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_span", F.last(F.when(F.col("at") == 0, last), ignorenulls=True).over(before))
    return both.where((F.col("at") == 1) & (F.col("id") <= F.col("_span.high"))).select(*rows.columns, F.col("_span.low").alias("low"))


def missing(ids: DataFrame, spans: DataFrame) -> DataFrame:
    """What is left of ``spans`` without ``ids`` (one column, ``id``): spans of ids that are still missing."""
    bits = _block_bits(spans)
    cut = _in_blocks(spans, bits)
    seen = ids.where("id IS NOT NULL").select(F.shiftright("id", bits).alias("block"), "id")
    inside = _placed(seen, cut).select("block", "low", "id").distinct()
    marks = inside.unionByName(cut.select("block", "low", (F.col("high") + 1).alias("id")))
    ordered = Window.partitionBy("block", "low").orderBy("id")
    gaps = marks.select("block", "low", F.coalesce(F.lag("id").over(ordered) + 1, F.col("low")).alias("from"), (F.col("id") - 1).alias("to"))
    gaps = gaps.where(F.col("from") <= F.col("to"))
    return gaps.join(cut.select("block", "low", "since"), ["block", "low"]).select(F.col("from").alias("low"), F.col("to").alias("high"), "since")


def ledger(ids: DataFrame, known: DataFrame | None, low: int, high: int, as_of: datetime, keep_minutes: int) -> DataFrame:
    """The next ledger: known spans and the window ``(low, high]``, without the ids that were read, and without spans missed for
    longer than ``keep_minutes``, which no open transaction can fill any more. They were probed once more before, so a pause between runs
    loses nothing."""
    window = ids.sparkSession.createDataFrame([(low + 1, high, as_of)] if high > low else [], SPANS)
    spans = window
    if known is not None:
        spans = spans.unionByName(known.where(F.col("since") >= ntz(as_of - timedelta(minutes=keep_minutes))))
    return missing(ids, spans)
