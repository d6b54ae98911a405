"""Questions asked of the run log: health, history, freshness, parity summaries.

Aggregates group on the map side first, so a table or batch that owns much of the
log sends one partial row per task. Listings sort on enough columns to be total,
which also lets a range sort split a run of equal times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import mentions

# Statuses in the order the trend shows them.
TREND_STATUSES = ("success", "failed", "skipped", "mismatch")
ERROR_PREFIX = 120
FIRST_BATCH = 10_000


def _one_decimal(x: Column) -> Column:
    return F.round(x, 1).cast("decimal(18,1)")


def _percent(part: Column, whole: Column) -> Column:
    exact = part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return F.coalesce(_one_decimal(exact), F.lit(0).cast("decimal(18,1)"))


def recent(log: DataFrame, as_of: Column, hours: int, column: str = "inserted_at") -> DataFrame:
    return log.where(F.col(column) > as_of - F.expr(f"INTERVAL {int(hours)} HOUR"))


def failed_runs(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return recent(log.where("status = 'failed'"), as_of, hours).orderBy(F.desc("inserted_at"), "run_no")


def validation_mismatches(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    rows = recent(log.where("load_type = 'validate' AND status = 'mismatch'"), as_of, hours)
    return rows.select(
        "table_no",
        F.col("rows_extracted").alias("source_rows"),
        F.col("rows_loaded").alias("raw_live_rows"),
        "error_message",
        "inserted_at",
    ).orderBy(F.desc("inserted_at"), "table_no")


def latest_run_per_table(log: DataFrame, table: Sequence[str], tie: str) -> DataFrame:
    w = Window.partitionBy(*table).orderBy(F.desc("inserted_at"), F.desc(tie))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stale_tables(log: DataFrame, table: Sequence[str], as_of: Column, hours: int = 24) -> DataFrame:
    """Tables without a success inside the window, never-succeeded first."""
    last = F.max(F.when(F.col("status") == "success", F.col("inserted_at")))
    rows = log.groupBy(*table).agg(last.alias("last_success"))
    limit = as_of - F.expr(f"INTERVAL {int(hours)} HOUR")
    return rows.where(F.col("last_success").isNull() | (F.col("last_success") < limit)).orderBy(
        F.asc_nulls_first("last_success"), *table
    )


def stale_active(config: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    last = F.col("last_loaded_at")
    limit = as_of - F.expr(f"INTERVAL {int(hours)} HOUR")
    return config.where(F.col("active") & (last.isNull() | (last < limit))).orderBy(
        last.asc_nulls_first(), "config_id"
    )


def error_frequency(log: DataFrame, top: int | None = 20) -> DataFrame:
    """Recurring errors by message prefix, most frequent first."""
    rows = (
        log.where("status = 'failed' AND error_message IS NOT NULL")
        .groupBy(F.left("error_message", F.lit(ERROR_PREFIX)).alias("error_prefix"))
        .agg(F.count(F.lit(1)).alias("occurrences"), F.max("inserted_at").alias("last_seen"))
        .orderBy(F.desc("occurrences"), "error_prefix")
    )
    return rows.limit(top) if top else rows


def run_summary(log: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "success")
    return log.agg(total.alias("total_runs"), ok.alias("_ok"),
                   F.count_if(F.col("status") == "failed").alias("failed_runs"),
                   F.avg("duration_sec").alias("_avg")).select(
        "total_runs",
        _percent(F.col("_ok"), F.col("total_runs")).alias("success_pct"),
        "failed_runs",
        F.coalesce(_one_decimal(F.col("_avg")), F.lit(0).cast("decimal(18,1)")).alias("avg_duration_sec"),
    )


def daily_trend(log: DataFrame, statuses: Sequence[str] = TREND_STATUSES) -> DataFrame:
    """Runs per day and status, one column per status, gaps as 0."""
    return (
        log.groupBy(F.to_date("inserted_at").alias("run_date"))
        .pivot("status", list(statuses))
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=list(statuses))
    )


def batch_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id").agg(
        F.max("inserted_at").alias("batch_time"),
        F.count(F.lit(1)).alias("tables"),
        F.count_if(F.col("status") == "success").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("duration_sec").alias("total_sec"),
    ).withColumn("state", F.when(F.col("failed") == 0, "✅").otherwise("❌"))


def parity_summary(checks: DataFrame) -> DataFrame:
    """Over per-table parity rows ``(sync, live_rows, delta)``."""
    return checks.agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(F.col("sync") == "in_sync").alias("_in"),
        F.count_if(F.col("sync") == "out_of_sync").alias("out_of_sync"),
        F.sum("live_rows").alias("total_live_rows"),
        F.avg(F.abs("delta")).alias("_avg"),
    ).select(
        "tables",
        _percent(F.col("_in"), F.col("tables")).alias("in_sync_pct"),
        "out_of_sync",
        "total_live_rows",
        F.round(F.col("_avg").cast("decimal(18,6)"), 0).cast("bigint").alias("mean_abs_delta"),
    )


def status_counts(config: DataFrame) -> DataFrame:
    status = F.lower(F.coalesce(F.col("last_run_status"), F.lit("")))
    return config.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("active")).alias("active"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "").alias("pending"),
    )


def next_batch_id(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Each job with the number of the batch about to start."""
    top = log.agg(F.coalesce(F.max("batch_id") + 1, F.lit(FIRST_BATCH).cast("bigint")).alias("n"))
    return jobs.withColumn("batch_id", top.scalar())


def last_success_cursor(audit: DataFrame, table: Sequence[str], cursor: str) -> DataFrame:
    """Cursor of each table's greatest successful batch (latest cursor on a tie)."""
    return audit.where("status = 'success'").groupBy(*table).agg(
        F.max("batch_id").alias("batch_id"), F.max_by(cursor, F.struct("batch_id", cursor)).alias("cursor")
    )


def distinct_values(log: DataFrame, column: str) -> DataFrame:
    return log.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def search(config: DataFrame, term: str, *columns: str) -> DataFrame:
    return config.where(mentions(term, *columns))


def history(
    log: DataFrame,
    table: object | None = None,
    status: str | None = None,
    load_type: str | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """Run history under the chosen filters. Days become a time range on the bare
    column, so the filter reaches the scan."""
    rows = log
    for name, value in (("table_no", table), ("status", status), ("load_type", load_type)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    if first_day:
        rows = rows.where(F.col("inserted_at") >= F.lit(first_day).cast("timestamp_ntz"))
    if last_day:
        rows = rows.where(
            F.col("inserted_at") < F.lit(last_day).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
        )
    return rows


def newest(log: DataFrame, count: int, tie: str = "run_no") -> DataFrame:
    return log.orderBy(F.desc("inserted_at"), F.desc(tie)).limit(count)


def report_view(log: DataFrame) -> DataFrame:
    """The log with a detail text per kind of run."""

    def count(name: str, missing: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(missing))

    detail = (
        F.when(F.col("load_type") == "reconcile", F.concat(F.lit("deleted="), count("rows_loaded", "0")))
        .when(
            F.col("load_type") == "validate",
            F.concat(F.lit("source="), count("rows_extracted", "?"), F.lit(" raw="), count("rows_loaded", "?")),
        )
        .otherwise(
            F.concat(F.lit("extracted="), count("rows_extracted", "0"), F.lit(" loaded="), count("rows_loaded", "0"))
        )
    )
    return log.withColumn("row_detail", detail)


def promote(log: DataFrame, audit: DataFrame, batch_id: int) -> DataFrame:
    """The audit table with one batch's log rows added, in the audit table's columns."""
    rows = log.where(F.col("batch_id") == F.lit(batch_id))
    return audit.unionByName(rows, allowMissingColumns=True).select(*audit.columns)


def rows_loaded_total(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(F.coalesce(F.sum("rows_loaded"), F.lit(0)).alias("rows_loaded"))
