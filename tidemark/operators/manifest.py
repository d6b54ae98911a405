"""The file manifest: registration, status, backlog, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.apply import any_null, key_set, no_nulls

PENDING = ("extracted", "uploaded")


def register(files: DataFrame, run_id: str, extracted_at: Column) -> DataFrame:
    """One manifest row per file read, with its size and row count."""
    return files.groupBy(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size_bytes")
    ).agg(F.count(F.lit(1)).alias("row_count")).withColumns(
        {
            "run_id": F.lit(run_id),
            "extracted_at": extracted_at.cast("timestamp_ntz"),
            "uploaded_at": F.lit(None).cast("timestamp_ntz"),
            "loaded_at": F.lit(None).cast("timestamp_ntz"),
            "status": F.lit("extracted"),
        }
    )


def set_status(manifest: DataFrame, changes: DataFrame, key: str = "manifest_id") -> DataFrame:
    """Status changes ``(key, status, changed_at)`` applied; the newest change wins and
    the time lands in the column of its status."""
    last = changes.groupBy(key).agg(
        F.max_by("status", F.struct("changed_at", "status")).alias("_status"), F.max("changed_at").alias("_at")
    )
    new = F.col("_status")
    return manifest.join(last, key, "left").withColumns(
        {
            "uploaded_at": F.when(new == "uploaded", F.col("_at")).otherwise(F.col("uploaded_at")),
            "loaded_at": F.when(new == "loaded", F.col("_at")).otherwise(F.col("loaded_at")),
            "status": F.coalesce(new, F.col("status")),
        }
    ).select(*manifest.columns)


def pending(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files extracted or uploaded but not loaded, oldest run first."""
    return (
        manifest.where(F.col("status").isin(*PENDING))
        .join(key_set(loaded, ["manifest_id"]), "manifest_id", "left_anti")
        .orderBy("run_at", "manifest_id")
    )


def newest_runs(manifest: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` runs of each config. Files are reduced to runs before ranking,
    so the ranking sees runs, not files."""
    runs = manifest.select("config_id", "run_at").distinct()
    w = Window.partitionBy("config_id").orderBy(F.desc("run_at"))
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def latest_run_files(manifest: DataFrame) -> DataFrame:
    latest = manifest.groupBy("config_id").agg(F.max("run_at").alias("run_at"))
    return manifest.join(latest, ["config_id", "run_at"], "left_semi")


def retain(manifest: DataFrame, keep: int = 5) -> DataFrame:
    """Manifest rows of each config's newest runs. Rows without a config or run belong to
    no list of runs and stay."""
    key = ["config_id", "run_at"]
    kept = manifest.join(newest_runs(manifest.where(no_nulls(key)), keep), key, "left_semi")
    return kept.unionByName(manifest.where(any_null(key)))


def rollup(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status", "storage_type", "file_format").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("file_size_bytes").alias("total_bytes"),
        F.sum("row_count").alias("total_rows"),
    )
