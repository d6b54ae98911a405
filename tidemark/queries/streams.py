"""File streams run to the end of what is there."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.values import ntz
from tidemark.operators.apply import upsert
from tidemark.operators.shape import with_audit
from tidemark.queries.deltas import BATCH_ID, BATCH_TS, KEYS, UPSERT_SQL
from tidemark.queries.registry import derived, query, table
from tidemark.session import work_path
from tidemark.sinks.tables import KeyedTable
from tidemark.sources import files
from tidemark.sources.scan import with_lookback
from tidemark.streaming import ingest as streams


def _landed(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The events as files in a landing folder, one per event type."""
    folder, events = work_path(spark, "landing"), table(spark, sf, "events")
    events.withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(folder)
    return folder, events


@query("stream_ingest", "SELECT * FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    folder, events = _landed(spark, sf)
    path, checkpoint = work_path(spark, "ingested"), work_path(spark, "checkpoint")
    for _run in range(2):  # the second run finds nothing new
        stream = streams.file_stream(spark, f"{folder}/*", events.schema, files_per_batch=2)
        streams.ingest(stream, path, checkpoint)
    return spark.read.schema(events.schema).parquet(path)


def _cleaned(spark: SparkSession, sf: str, clean: str) -> DataFrame:
    """Rows by where they are: loaded, still in the landing folder, in the archive. A batch's files go when
    the next one commits, so an empty file comes last to let all others go."""
    folder, events = _landed(spark, sf)
    path, checkpoint, kept = work_path(spark, "cleaned"), work_path(spark, "checkpoint"), work_path(spark, "archive")
    spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")  # done when the run is
    for run in range(2):
        if run:
            events.limit(0).coalesce(1).write.parquet(f"{folder}/kind=last")
        stream = streams.file_stream(
            spark, f"{folder}/*", events.schema, files_per_batch=1, clean=clean, archive_dir=kept
        )
        streams.ingest(stream, path, checkpoint)

    def rows(place: str, where: str) -> DataFrame:
        found = files.load_or_none(lambda: spark.read.schema(events.schema).option("recursiveFileLookup", True).parquet(where))
        return (events.limit(0) if found is None else found).select(F.lit(place).alias("place"), "event_id", "user_id", "event_type", "ts")

    return rows("loaded", path).unionByName(rows("landing", folder)).unionByName(rows("archive", kept))


CLEANED_SQL = "SELECT 'loaded' AS place, event_id, user_id, event_type, ts FROM events"


@query("stream_purge", CLEANED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf, "delete")


@query("stream_archive", f"{CLEANED_SQL} UNION ALL SELECT 'archive', event_id, user_id, event_type, ts FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf, "archive")


@query("stream_upsert", UPSERT_SQL.replace(f"'{BATCH_ID}'", "'s0'"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    delta, folder = derived(spark, sf, "f_delta"), work_path(spark, "delta-files")
    delta.write.parquet(folder)
    stored = KeyedTable(spark, work_path(spark, "stream-target"), tuple(KEYS), 16)
    stored.create(derived(spark, sf, "f_target"))
    checkpoint = work_path(spark, "checkpoint")
    for _run in range(2):
        stream = streams.file_stream(spark, folder, delta.schema)
        streams.stream_upsert(stream, stored, checkpoint, BATCH_TS, "updated_at")
    return stored.read()


@query("stream_lag_guard", "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 MINUTE")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of files, some of whose rows are too young when they come: those of the middle of the month
    wait for a later batch, those of its end are still held."""
    (folder, events), path = _landed(spark, sf), work_path(spark, "lag-guard")
    held, checkpoint, clocks = work_path(spark, "held"), work_path(spark, "checkpoint"), iter([datetime(2024, 1, 15)])
    stream = streams.file_stream(spark, f"{folder}/*", events.schema, files_per_batch=1)
    streams.stream_settled(stream, "ts", 1, path, held, checkpoint, lambda: next(clocks, datetime(2024, 1, 30)))
    return spark.read.schema(events.schema).option("recursiveFileLookup", True).parquet(path)


@query(
    "stream_lag_state",
    """SELECT *, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 1 MINUTE AND event_id % 3 = 0)
          + (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-12 00:00:00' - INTERVAL 1 MINUTE AND event_id % 3 = 1)
          + (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 MINUTE AND event_id % 3 = 2) AS written_to_wait
       FROM events WHERE ts <= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 1 MINUTE""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of rows and two of none, a restart before each: every row is written to wait at most once, and comes
    when it is old enough."""
    events, folder, path = table(spark, sf, "events"), work_path(spark, "lag-state"), work_path(spark, "lag-out")
    held, checkpoint, waited = work_path(spark, "held"), work_path(spark, "checkpoint"), 0
    for n, day in enumerate((5, 12, 20, 24, 28)):
        part = events.where(F.col("event_id") % 3 == n).repartition(1) if n < 3 else events.limit(0).coalesce(1)
        part.write.mode("append").parquet(folder)
        stream = streams.file_stream(spark, folder, events.schema)
        streams.stream_settled(stream, "ts", 1, path, held, checkpoint, lambda day=day: datetime(2024, 1, day), slot_minutes=24 * 60)
        mine = files.load_or_none(lambda: spark.read.schema(f"{streams.SLOT} bigint, {streams.BATCH} bigint").parquet(f"{held}/rows"))
        waited += 0 if mine is None else mine.where(F.col(streams.BATCH) == n).count()
    return spark.read.schema(events.schema).option("recursiveFileLookup", True).parquet(path).withColumn("written_to_wait", F.lit(waited))


@query(
    "late_rows_lookback",
    """SELECT user_id, event_id, ts, event_type, TIMESTAMP '2024-01-31 00:00:00' AS _load_ts,
              CAST(NULL AS VARCHAR) AS _src_file, 'b2' AS _batch_id, FALSE AS _is_deleted, CAST(NULL AS TIMESTAMP) AS _deleted_at
       FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 120 MINUTE AND ts <= TIMESTAMP '2024-01-25 00:00:00'
       UNION ALL
       SELECT user_id, event_id, ts, event_type, TIMESTAMP '2024-01-20 00:00:00', NULL, 'b1', FALSE, NULL
       FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 120 MINUTE AND event_type <> 'click'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks arrive late: the first run missed them, the next one re-reads two hours."""
    cursor = "2024-01-20 00:00:00"
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    first = events.where((F.col("ts") <= ntz(cursor)) & (F.col("event_type") != "click"))
    target = with_audit(first, ntz(cursor), "b1")
    delta = with_lookback(events, "ts", cursor, 120, "2024-01-25 00:00:00")
    return upsert(target, delta, ["event_id"], ntz("2024-01-31 00:00:00"), "b2", "ts")
