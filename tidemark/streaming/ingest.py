"""File streams: each new file once, upserts per micro-batch, lag guard, clean-up.

The checkpoint is the record of what was loaded. Checkpoints and tables live in the
shared folder, so a lost executor or driver resumes from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.values import literal_for, ntz, time_ceiling
from tidemark.operators.apply import apply_history, upsert
from tidemark.sinks import storage
from tidemark.sinks.tables import KeyedTable
from tidemark.sources.scan import within


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    clean: str = "off",
    archive_dir: str | None = None,
    **options: str,
) -> DataFrame:
    """New files of a folder. ``clean`` is ``off``, ``delete`` or ``archive``; Spark
    cleans a batch's files when the next batch commits."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if clean != "off":
        reader = reader.option("cleanSource", clean)
    if clean == "archive":
        reader = reader.option("sourceArchiveDir", archive_dir)
    return reader.load(folder)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append every new file's rows to a Parquet folder; returns the batches that ran, as the
    checkpoint counts them."""
    spark, before = stream.sparkSession, _commits(stream.sparkSession, checkpoint)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(path)
    )
    query.awaitTermination()
    return len(_commits(spark, checkpoint) - before)


def _commits(spark: SparkSession, checkpoint: str) -> set[str]:
    return {n for n in storage.children(spark, f"{checkpoint}/commits") if n.isdigit()}


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def stream_upsert(
    stream: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    batch_ts: str,
    watermark: str | None = None,
    history: bool = False,
) -> None:
    """Apply each micro-batch to a keyed table. A replayed batch has the same number under the same
    checkpoint, and the table knows the last one of each checkpoint that it took."""
    change = apply_history if history else upsert
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def handle(batch: DataFrame, number: int) -> None:
        def apply(target: DataFrame, delta: DataFrame, small: bool) -> DataFrame:
            return change(target, delta, table.keys, ntz(batch_ts), f"s{number}", watermark, small=small)

        batch.persist()
        try:
            if batch.isEmpty() or number <= table.last_number(writer):
                return
            table.apply(batch, apply, str(number), writer=writer)
        finally:
            batch.unpersist()

    for_each_batch(stream, handle, checkpoint)


SLOT, BATCH = "_slot", "_batch"


def stream_settled(
    stream: DataFrame, column: str, lag_minutes: int, path: str, held: str, checkpoint: str, clock: Callable[[], datetime], slot_minutes: int = 360
) -> None:
    """Append rows once they are old enough: younger ones than the source's clock less the lag wait below ``held``.

    Waiting rows lie in folders by slots of time and are written once. A batch reads the slots between the ceiling of the
    batch before and its own, and takes the rows between the two: its work is its own rows and those that it sets free, whatever else
    is held. Its ceiling is stored first, and what it writes is named by its number, so a replayed batch replaces its
    own. Slots that are free as a whole are removed by the next batch. Rows without a time do not wait."""

    def handle(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{held}/ceilings"
        storage.publish_text(spark, f"{at}/{number:012d}", time_ceiling(clock(), lag_minutes).isoformat(" "))
        known = [storage.read_text(spark, f"{at}/{n:012d}") for n in (number, number - 1) if n >= 0]
        before = max(known[1:], default=None)
        ceiling = max(known)  # a clock that went back frees nothing again
        if ceiling != known[0]:
            storage.replace_text(spark, f"{at}/{number:012d}", ceiling)
        slot = lambda time: F.floor(F.unix_micros(time.cast("timestamp")) / (slot_minutes * 60_000_000))
        value, limit = F.col(f"`{column}`"), literal_for(batch, column, ceiling)
        young = F.coalesce(value > limit, F.lit(False))
        rows = batch.persist()
        try:
            for old in storage.matching(spark, f"{held}/rows/{SLOT}=*/{BATCH}={number}"):
                storage.purge(spark, old)
            slots = rows.where(young).withColumns({SLOT: slot(value), BATCH: F.lit(number)})
            slots.write.mode("append").partitionBy(SLOT, BATCH).parquet(f"{held}/rows")
            free = rows.where(~young)
            if before is not None:
                schema = T.StructType([*batch.schema.fields, T.StructField(SLOT, T.LongType()), T.StructField(BATCH, T.LongType())])
                waiting = spark.read.schema(schema).parquet(f"{held}/rows")
                low = literal_for(batch, column, before)
                due = waiting.where(F.col(SLOT).between(slot(low), slot(limit)) & (F.col(BATCH) < number) & (value > low) & (value <= limit))
                free = free.unionByName(due.select(*[F.col(f"`{c}`") for c in batch.columns]))
            free.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()
        if before is not None:
            done = spark.range(1).select(slot(literal_for(batch, column, before))).first()[0]
            for name in storage.children(spark, f"{held}/rows"):
                if name.startswith(f"{SLOT}=") and name[len(SLOT) + 1 :].lstrip("-").isdigit() and int(name.split("=")[1]) < done:
                    storage.purge(spark, f"{held}/rows/{name}")

    for_each_batch(stream, handle, checkpoint)


def guarded(batch: DataFrame, column: str, cursor: object, ceiling: datetime) -> DataFrame:
    """The rows of a window that are old enough; younger ones come with the next run,
    whose cursor starts at this ceiling."""
    return within(batch, column, cursor, ceiling)


def ingest_windows(
    source: DataFrame, column: str, cursor: object, ceilings: Sequence[datetime], write: Callable[[DataFrame], None]
) -> object:
    """One run per ceiling: each reads ``(cursor, ceiling]``, commits, then moves the
    cursor. Returns the last cursor."""
    for ceiling in ceilings:
        write(guarded(source, column, cursor, ceiling))
        cursor = ceiling
    return cursor
