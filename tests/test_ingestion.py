"""File ingestion jobs."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from tidemark.plans.ingestion import IngestJob, run_batch, run_job
from tidemark.session import work_path
from tidemark.sources.files import FileFormat


def test_job_counts_per_file_and_loads_the_dated_folder(spark):
    base, name = work_path(spark, "land"), f"t_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "a"), (2, "b,c")], "id int, t string")
    rows.coalesce(1).write.option("header", True).csv(f"{base}/20240131/orders")
    rows.coalesce(1).write.option("header", True).csv(f"{base}/20240131/other")
    job = IngestJob(1, name, base, ".*/orders/.*", "overwrite", False, FileFormat(skip_header=1), rows.schema,
                    date(2024, 1, 31), table_path=work_path(spark, "tab"))
    record, counts = run_job(spark, job, 10_000)
    assert (record["status"], record["source_count"]) == ("SUCCESS", 2)
    assert [r.row_count for r in counts.collect()] == [2]
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (2, "b,c")]


def test_append_to_a_missing_table_is_recorded_as_failed(spark):
    base, audit = work_path(spark, "land"), work_path(spark, "audit")
    spark.range(3).write.json(base)
    jobs = [
        IngestJob(1, "no_such_table_1", base, fmt=FileFormat("JSON")),
        IngestJob(2, "off", base, fmt=FileFormat("JSON"), enabled=False),
    ]
    records = run_batch(spark, jobs, 10_001, audit)
    assert [(r["job_id"], r["status"]) for r in records] == [(1, "FAILED")]
    kept = spark.read.parquet(audit)
    assert kept.where("status = 'FAILED'").count() == 1 and "does not exist" in kept.first().message


def test_parquet_and_inferred_schema(spark):
    base, name = work_path(spark, "land"), f"t_{uuid.uuid4().hex}"
    spark.range(5).withColumn("v", F.lit("x")).write.parquet(base)
    job = IngestJob(1, name, base, load_mode="append", table_exists=False, fmt=FileFormat("PARQUET"),
                    table_path=work_path(spark, "tab"))
    assert run_job(spark, job, 1)[0]["status"] == "SUCCESS" and run_job(spark, job, 2)[0]["status"] == "SUCCESS"
    assert spark.table(name).count() == 10


def test_bad_records_end_the_job_or_are_kept_apart(spark):
    base, rejects, name = work_path(spark, "land"), work_path(spark, "rejects"), f"t_{uuid.uuid4().hex}"
    spark.createDataFrame([("1,a",), ("x,b",), ("3,c",)], "value string").coalesce(1).write.text(base)
    schema = spark.createDataFrame([], "id int, t string").schema
    job = IngestJob(1, name, base, load_mode="overwrite", table_exists=False, schema=schema, table_path=work_path(spark, "tab"))
    failed, _ = run_job(spark, job, 1)
    assert failed["status"] == "FAILED" and failed["loaded_count"] is None
    record, counts = run_job(spark, replace(job, rejects_path=rejects), 2)
    assert (record["status"], record["source_count"], record["loaded_count"], record["rejected_count"]) == ("SUCCESS", 3, 2, 1)
    assert [r.row_count for r in counts.collect()] == [3]
    assert sorted(r.id for r in spark.table(name).collect()) == [1, 3]
    assert [r["_corrupt_record"] for r in spark.read.parquet(rejects).collect()] == ["x,b"]


def test_skipped_lines_and_a_pattern(spark):
    base, name = work_path(spark, "land"), f"t_{uuid.uuid4().hex}"
    for kind in ("good", "other"):
        lines = [(f"{kind} heading {i}",) for i in range(3)] + [(f"{i},{kind}",) for i in range(5)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{base}/{kind}")
    schema = spark.createDataFrame([], "id int, t string").schema
    job = IngestJob(1, name, base, ".*/good/.*", "overwrite", False, FileFormat(skip_header=3), schema, table_path=work_path(spark, "tab"))
    record, counts = run_job(spark, job, 1)
    assert (record["status"], record["loaded_count"]) == ("SUCCESS", 5) and counts.count() == 1
    assert {r.t for r in spark.table(name).collect()} == {"good"}
