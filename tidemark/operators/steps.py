"""Questions asked of the step log: where to resume, what failed, how long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resume_points(steps: DataFrame) -> DataFrame:
    """First step of each run, by order, that is neither done nor skipped."""
    return steps.where(~F.col("status").isin("success", "skipped")).groupBy("run_id").agg(
        F.min_by("step_name", "step_order").alias("resume_step")
    )


def last_run_per_config(steps: DataFrame) -> DataFrame:
    """Newest run of each config; runs that never started come last."""
    order = F.struct(F.col("started_at").isNotNull(), F.col("started_at"), F.col("run_id"))
    return steps.groupBy("config_id").agg(F.max_by("run_id", order).alias("run_id"))


def retryable_runs(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg((F.count_if(F.col("status") == "failed") > 0).alias("can_resume"))


def first_failed_step(steps: DataFrame) -> DataFrame:
    return steps.where("status = 'failed'").groupBy("run_id").agg(
        F.min_by("step_name", "step_order").alias("step_name"), F.min("step_order").alias("step_order")
    )


def step_failures(steps: DataFrame) -> DataFrame:
    return steps.where("status = 'failed'").groupBy("step_name").agg(F.count(F.lit(1)).alias("failure_count"))


def progress(steps: DataFrame, as_of: Column) -> DataFrame:
    """Every step with its elapsed seconds; running steps count up to ``as_of``."""
    return steps.withColumn(
        "elapsed_sec", F.timestamp_diff("SECOND", F.col("started_at"), F.coalesce(F.col("ended_at"), as_of))
    )
