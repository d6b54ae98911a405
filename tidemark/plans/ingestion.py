"""File ingestion jobs: declare a format, count rows per file, prepare the table, load."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.operators import parity
from tidemark.sinks.tables import MissingTableError, create_if_missing, write_table
from tidemark.session import work_path
from tidemark.sources.files import CORRUPT, SOURCE, FileFormat, dated_path, read_after_lines, read_declared, read_matching

AUDIT_SCHEMA = (
    "batch_id bigint, job_id bigint, table_name string, load_mode string, source_path string, source_count bigint, "
    "loaded_count bigint, rejected_count bigint, status string, message string, started_at timestamp_ntz, ended_at timestamp_ntz"
)


@dataclass(frozen=True)
class IngestJob:
    """``load_mode`` is ``append`` or ``overwrite``; ``table_exists`` says whether the table
    must be there already. Without a schema it is inferred from the files. A bad record ends the
    job, unless ``rejects_path`` names a folder for such records (then a schema is needed)."""

    job_id: int
    table: str
    path: str
    pattern: str = ".*"
    load_mode: str = "append"
    table_exists: bool = True
    fmt: FileFormat = field(default_factory=FileFormat)
    schema: T.StructType | None = None
    run_date: date | None = None
    enabled: bool = True
    table_path: str | None = None
    rejects_path: str | None = None


def source_rows(spark: SparkSession, job: IngestJob) -> DataFrame:
    """The job's files, those below its folder whose path matches its pattern, with the file of each
    row as ``SOURCE`` and, if the job keeps rejects, the text of bad records as ``CORRUPT``."""
    folder = dated_path(job.path, job.run_date)
    fmt = replace(job.fmt, extras={**job.fmt.extras, "recursiveFileLookup": "true"})
    schema = job.schema
    if job.rejects_path:
        if schema is None or fmt.kind == "PARQUET":
            raise ValueError("rejects need a schema and a text format")
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        fmt = replace(fmt, extras={**fmt.extras, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    if fmt.kind == "CSV" and fmt.skip_header > 1:
        return read_after_lines(spark, folder, fmt, schema, job.pattern)
    rows = read_matching(lambda s: read_declared(s, folder, fmt, schema), spark, job.pattern)
    return rows.withColumn(SOURCE, F.col("_metadata.file_path"))


def run_job(spark: SparkSession, job: IngestJob, batch_id: int) -> tuple[dict, DataFrame | None]:
    """Load one job; returns its audit record and the rows per file.

    The files are read once: rows are counted as they are written. A job that keeps rejects reads them into
    a table of its own, from which good and bad rows part. The rows per file are counted when asked for."""
    record = {
        "batch_id": batch_id, "job_id": job.job_id, "table_name": job.table, "load_mode": job.load_mode,
        "source_path": dated_path(job.path, job.run_date), "source_count": None, "loaded_count": None, "rejected_count": None,
        "status": "FAILED", "message": None, "started_at": _now(),
    }
    counts = None
    try:
        rows = source_rows(spark, job)
        loaded = rows.drop(SOURCE, CORRUPT)
        if job.table_exists and not spark.catalog.tableExists(job.table):
            raise MissingTableError(f"{job.table} does not exist")
        if not job.table_exists:
            create_if_missing(spark, job.table, loaded.schema, job.table_path)
        if job.rejects_path:
            path = work_path(spark, f"ingest-{job.job_id}")
            rows.write.parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
            bad = F.col(CORRUPT).isNotNull()
            rejected = _counted(rows.where(bad).select(SOURCE, CORRUPT), lambda r: r.write.mode("append").parquet(job.rejects_path))
            loaded = rows.where(~bad).drop(SOURCE, CORRUPT)
        else:
            rejected = 0
        n = _counted(loaded, lambda r: write_table(r, job.table, job.load_mode, job.table_path))
        counts = parity.rows_per_file(rows, F.col(SOURCE))
        record.update(status="SUCCESS", source_count=n + rejected, loaded_count=n, rejected_count=rejected)
    except Exception as error:  # the record is what the audit table keeps
        record["message"] = str(error)
    return {**record, "ended_at": _now()}, counts


def _counted(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write rows; how many there were."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def run_batch(spark: SparkSession, jobs: Iterable[IngestJob], batch_id: int, audit_path: str) -> list[dict]:
    """All enabled jobs of a batch, then their records into the audit table at once."""
    records = [run_job(spark, job, batch_id)[0] for job in jobs if job.enabled]
    spark.createDataFrame(records, AUDIT_SCHEMA).write.mode("append").parquet(audit_path)
    return records


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
