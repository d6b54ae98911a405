"""File streams: once-only reading, clean-up, replay, lag."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.values import ntz
from tidemark.operators import shape
from tidemark.session import work_path
from tidemark.sinks.tables import KeyedTable
from tidemark.streaming import ingest

SCHEMA = "k int, v string, w int"


def drop_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def names(folder):
    return sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_second_run_reads_nothing(spark):
    folder, path, mark = (work_path(spark, n) for n in ("in", "out", "mark"))
    drop_file(spark, folder, [(1, "a", 1)])
    run = lambda: ingest.ingest(ingest.file_stream(spark, folder, schema(spark)), path, mark)
    assert run() == 1 and run() == 0
    drop_file(spark, folder, [(2, "b", 1)])
    assert run() == 1 and spark.read.parquet(path).count() == 2


def test_cleaning_acts_one_batch_late(spark):
    for clean in ("delete", "archive"):
        folder, path, mark, kept = (work_path(spark, n) for n in ("in", "out", "mark", "kept"))
        drop_file(spark, folder, [(1, "a", 1)])
        first = names(folder)
        run = lambda: ingest.ingest(
            ingest.file_stream(spark, folder, schema(spark), clean=clean, archive_dir=kept), path, mark
        )
        run()
        drop_file(spark, folder, [(2, "b", 1)])
        run()
        assert first[0] not in names(folder)
        moved = [f for _, _, fs in os.walk(kept) for f in fs if f in first] if os.path.exists(kept) else []
        assert bool(moved) == (clean == "archive")
        assert spark.read.parquet(path).count() == 2


def test_stream_upsert_batches_and_history(spark):
    for history in (False, True):
        folder, mark = work_path(spark, "in"), work_path(spark, "mark")
        drop_file(spark, folder, [(1, "a", 1), (1, "b", 2)])
        table = KeyedTable(spark, work_path(spark, "t"), ("k",), 4, "NOT _is_current" if history else None)
        base = shape.with_audit(spark.createDataFrame([(1, "z", 0), (9, "y", 0)], SCHEMA), ntz("2024-01-01 00:00:00"), "b0")
        table.create(shape.with_history(base, ntz("2024-01-01 00:00:00")) if history else base)
        run = lambda: ingest.stream_upsert(
            ingest.file_stream(spark, folder, schema(spark)), table, mark, "2024-02-01 00:00:00", "w", history
        )
        run()
        drop_file(spark, folder, [(2, "c", 1)])
        run()
        rows = table.read().where("_is_current") if history else table.read()
        assert sorted((r.k, r.v) for r in rows.collect()) == [(1, "b"), (2, "c"), (9, "y")]
        assert table.read().count() == (4 if history else 3)


def test_windows_hold_young_rows_back(spark):
    source = spark.createDataFrame([(i, f"2024-01-01 00:0{i}:00") for i in range(6)], "i int, ts string")
    source = source.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    seen = []
    last = ingest.ingest_windows(
        source, "ts", "1900-01-01 00:00:00", [datetime(2024, 1, 1, 0, 2), datetime(2024, 1, 1, 0, 4)],
        lambda rows: seen.append(sorted(r.i for r in rows.collect())),
    )
    assert seen == [[0, 1, 2], [3, 4]] and last == datetime(2024, 1, 1, 0, 4)


def test_two_checkpoints_number_their_batches_alike(spark):
    table = KeyedTable(spark, work_path(spark, "t"), ("k",), 4)
    table.create(shape.with_audit(spark.createDataFrame([(9, "y", 0)], SCHEMA), ntz("2024-01-01 00:00:00"), "b0"))
    for k in range(3):
        folder, mark = work_path(spark, "in"), work_path(spark, "mark")
        drop_file(spark, folder, [(k, f"v{k}", 1)])
        for _ in range(2):
            ingest.stream_upsert(ingest.file_stream(spark, folder, schema(spark)), table, mark, "2024-02-01 00:00:00", "w")
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 9]


def test_batches_are_counted_beyond_kept_progress(spark):
    folder, path, mark = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "mark")
    for k in range(6):
        drop_file(spark, folder, [(k, "a", 1)])
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert ingest.ingest(ingest.file_stream(spark, folder, schema(spark), files_per_batch=1), path, mark) == 6
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert ingest.ingest(ingest.file_stream(spark, folder, schema(spark)), path, mark) == 0


def test_young_rows_wait_for_a_later_batch(spark):
    folder, path, held, mark = (work_path(spark, n) for n in ("in", "out", "held", "mark"))
    schema_ = "i int, ts timestamp_ntz"

    def run(rows, clock):
        df = spark.createDataFrame(rows, "i int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = ingest.file_stream(spark, folder, spark.createDataFrame([], schema_).schema)
        ingest.stream_settled(stream, "ts", 1, path, held, mark, lambda: clock)
        return sorted(r.i for r in spark.read.schema("i int").option("recursiveFileLookup", True).parquet(path).collect())

    first = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:05:30"), (3, None)]
    assert run(first, datetime(2024, 1, 1, 0, 6)) == [1, 3]
    assert run([(4, "2024-01-01 00:09:00")], datetime(2024, 1, 1, 0, 9, 30)) == [1, 2, 3]
    assert run([(5, "2024-01-01 00:01:00")], datetime(2024, 1, 1, 0, 20)) == [1, 2, 3, 4, 5]
