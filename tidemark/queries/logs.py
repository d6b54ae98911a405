"""Run log, step log, manifest and log text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import logs as lines
from tidemark.functions.values import ntz
from tidemark.operators import manifest, runlog, steps
from tidemark.queries.registry import derived, query, table

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "f_run_log")


@query(
    "failed_runs",
    f"SELECT * FROM f_run_log WHERE status = 'failed' AND inserted_at > {AS_OF_SQL} - INTERVAL 24 HOUR",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.failed_runs(_log(spark, sf), ntz(AS_OF))


@query(
    "validation_mismatches",
    f"""SELECT table_no, rows_extracted AS source_rows, rows_loaded AS raw_live_rows, error_message, inserted_at
        FROM f_run_log WHERE load_type = 'validate' AND status = 'mismatch'
          AND inserted_at > {AS_OF_SQL} - INTERVAL 72 HOUR""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.validation_mismatches(_log(spark, sf), ntz(AS_OF), 72)


@query(
    "latest_run_per_table",
    "SELECT * FROM f_run_log QUALIFY row_number() OVER (PARTITION BY table_no ORDER BY inserted_at DESC, run_no DESC) = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.latest_run_per_table(_log(spark, sf), ["table_no"], "run_no")


@query(
    "stale_tables",
    f"""SELECT table_no, max(CASE WHEN status = 'success' THEN inserted_at END) AS last_success FROM f_run_log
        GROUP BY table_no HAVING max(CASE WHEN status = 'success' THEN inserted_at END) IS NULL
            OR max(CASE WHEN status = 'success' THEN inserted_at END) < {AS_OF_SQL} - INTERVAL 24 HOUR""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.stale_tables(_log(spark, sf), ["table_no"], ntz(AS_OF))


@query(
    "stale_active_tables",
    """SELECT * FROM f_config WHERE active
       AND (last_loaded_at IS NULL OR last_loaded_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.stale_active(derived(spark, sf, "f_config"), ntz("2024-01-30 12:00:00"))


@query(
    "error_frequency",
    """SELECT left(error_message, 120) AS error_prefix, count(*) AS occurrences, max(inserted_at) AS last_seen
       FROM f_run_log WHERE status = 'failed' AND error_message IS NOT NULL
       GROUP BY 1 ORDER BY occurrences DESC, error_prefix LIMIT 20""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.error_frequency(_log(spark, sf))


@query("step_failures", "SELECT step_name, count(*) AS failure_count FROM f_step_log WHERE status = 'failed' GROUP BY step_name")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return steps.step_failures(derived(spark, sf, "f_step_log"))


@query(
    "manifest_rollup",
    """SELECT status, storage_type, file_format, count(*) AS file_count, sum(file_size_bytes) AS total_bytes,
              CAST(sum(row_count) AS BIGINT) AS total_rows FROM f_manifest GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.rollup(derived(spark, sf, "f_manifest"))


@query(
    "run_summary",
    """SELECT count(*) AS total_runs, CAST(round(CAST(count_if(status = 'success') AS DECIMAL(20,0)) * 100 / count(*), 1) AS DECIMAL(18,1)) AS success_pct,
              count_if(status = 'failed') AS failed_runs,
              CAST(round(CAST(sum(duration_sec) AS DOUBLE) / count(duration_sec), 1) AS DECIMAL(18,1)) AS avg_duration_sec
       FROM f_run_log""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_summary(_log(spark, sf))


@query(
    "daily_trend_pivot",
    """SELECT CAST(inserted_at AS DATE) AS run_date, count_if(status = 'success') AS success,
              count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped,
              count_if(status = 'mismatch') AS mismatch FROM f_run_log GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.daily_trend(_log(spark, sf))


@query(
    "batch_rollup",
    """SELECT batch_id, max(inserted_at) AS batch_time, count(*) AS tables, count_if(status = 'success') AS ok,
              count_if(status = 'failed') AS failed, sum(duration_sec) AS total_sec,
              CASE WHEN count_if(status = 'failed') = 0 THEN '✅' ELSE '❌' END AS state
       FROM f_run_log GROUP BY batch_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.batch_rollup(_log(spark, sf))


@query(
    "parity_summary",
    """SELECT count(*) AS tables, CAST(round(CAST(count_if(d = 0) AS DECIMAL(20,0)) * 100 / count(*), 1) AS DECIMAL(18,1)) AS in_sync_pct,
              count_if(d <> 0) AS out_of_sync, CAST(sum(rows_loaded) AS BIGINT) AS total_live_rows,
              CAST(round(CAST(avg(abs(d)) AS DECIMAL(18,6)), 0) AS BIGINT) AS mean_abs_delta
       FROM (SELECT rows_loaded, rows_extracted - rows_loaded AS d FROM f_run_log) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    delta = F.col("rows_extracted") - F.col("rows_loaded")
    checks = _log(spark, sf).select(
        F.when(delta == 0, "in_sync").otherwise("out_of_sync").alias("sync"),
        F.col("rows_loaded").alias("live_rows"),
        delta.alias("delta"),
    )
    return runlog.parity_summary(checks)


@query(
    "status_counts",
    """SELECT count(*) AS total, count_if(active) AS active, count_if(lower(last_run_status) = 'success') AS success,
              count_if(lower(last_run_status) = 'failed') AS failed, count_if(last_run_status IS NULL) AS pending FROM f_config""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.status_counts(derived(spark, sf, "f_config"))


@query(
    "next_batch_id",
    """SELECT config_id, source_table, (SELECT coalesce(max(batch_id) + 1, 10000) FROM f_run_log) AS batch_id
       FROM f_config WHERE active""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    jobs = derived(spark, sf, "f_config").where("active").select("config_id", "source_table")
    return runlog.next_batch_id(jobs, _log(spark, sf))


@query(
    "last_success_cursor",
    """SELECT table_no, max(batch_id) AS batch_id, arg_max(inserted_at, (batch_id, inserted_at)) AS cursor
       FROM f_run_log WHERE status = 'success' GROUP BY table_no""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.last_success_cursor(_log(spark, sf), ["table_no"], "inserted_at")


@query("distinct_values", "SELECT DISTINCT table_no FROM f_run_log WHERE table_no IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.distinct_values(_log(spark, sf), "table_no")


@query(
    "search_tables",
    """SELECT * FROM f_config WHERE contains(lower(source_db), 'b1') OR contains(lower(source_table), 'b1')
       OR contains(lower(target_table), 'b1')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.search(derived(spark, sf, "f_config"), "B1", "source_db", "source_table", "target_table")


@query(
    "history_filter",
    """SELECT * FROM f_run_log WHERE status = 'failed' AND load_type = 'full'
       AND CAST(inserted_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.history(
        _log(spark, sf), status="failed", load_type="full", first_day="2024-01-05", last_day="2024-01-25"
    )


@query("history_top_n", "SELECT * FROM f_run_log ORDER BY inserted_at DESC, run_no DESC LIMIT 50")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.newest(_log(spark, sf), 50)


@query(
    "run_log_view",
    """SELECT *, CASE load_type WHEN 'reconcile' THEN 'deleted=' || coalesce(CAST(rows_loaded AS VARCHAR), '0')
             WHEN 'validate' THEN 'source=' || coalesce(CAST(rows_extracted AS VARCHAR), '?') || ' raw=' || coalesce(CAST(rows_loaded AS VARCHAR), '?')
             ELSE 'extracted=' || coalesce(CAST(rows_extracted AS VARCHAR), '0') || ' loaded=' || coalesce(CAST(rows_loaded AS VARCHAR), '0')
        END AS row_detail FROM f_run_log""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.report_view(_log(spark, sf)).orderBy(F.desc("inserted_at"), "run_no")


@query(
    "rows_loaded_total",
    "SELECT load_type, CAST(sum(rows_loaded) AS BIGINT) AS rows_loaded FROM f_run_log GROUP BY load_type",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.rows_loaded_total(_log(spark, sf), ["load_type"])


@query(
    "resume_point",
    """SELECT run_id, arg_min(step_name, step_order) AS resume_step FROM f_step_log
       WHERE status NOT IN ('success', 'skipped') GROUP BY run_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return steps.resume_points(derived(spark, sf, "f_step_log"))


@query(
    "last_run_per_config",
    """SELECT config_id, run_id FROM (SELECT config_id, run_id FROM f_step_log
       QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY started_at DESC NULLS LAST, run_id DESC) = 1) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return steps.last_run_per_config(derived(spark, sf, "f_step_log"))


@query("retryable_runs", "SELECT run_id, count_if(status = 'failed') > 0 AS can_resume FROM f_step_log GROUP BY run_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return steps.retryable_runs(derived(spark, sf, "f_step_log"))


@query(
    "first_failed_step",
    """SELECT run_id, arg_min(step_name, step_order) AS step_name, min(step_order) AS step_order
       FROM f_step_log WHERE status = 'failed' GROUP BY run_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return steps.first_failed_step(derived(spark, sf, "f_step_log"))


@query(
    "step_progress",
    f"""SELECT *, CAST(trunc(epoch(coalesce(ended_at, {AS_OF_SQL}) - started_at)) AS BIGINT) AS elapsed_sec
        FROM f_step_log WHERE started_at IS NOT NULL
        UNION ALL SELECT *, NULL FROM f_step_log WHERE started_at IS NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return steps.progress(derived(spark, sf, "f_step_log"), ntz(AS_OF))


@query(
    "latest_run_files",
    """SELECT m.* FROM f_manifest m JOIN (SELECT config_id, max(run_at) AS run_at FROM f_manifest GROUP BY config_id) l
       ON m.config_id = l.config_id AND m.run_at = l.run_at""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.latest_run_files(derived(spark, sf, "f_manifest"))


@query(
    "manifest_retention",
    """SELECT * FROM f_manifest QUALIFY dense_rank() OVER (PARTITION BY config_id ORDER BY run_at DESC) <= 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.retain(derived(spark, sf, "f_manifest"), 5)


@query(
    "pending_files",
    """SELECT * FROM f_manifest m WHERE status IN ('extracted', 'uploaded')
       AND NOT EXISTS (SELECT 1 FROM f_manifest_changes c WHERE c.status = 'loaded' AND c.manifest_id = m.manifest_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    loaded = derived(spark, sf, "f_manifest_changes").where("status = 'loaded'")
    return manifest.pending(derived(spark, sf, "f_manifest"), loaded)


@query(
    "manifest_status",
    """WITH last AS (SELECT * FROM f_manifest_changes
           QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY changed_at DESC, status DESC) = 1)
       SELECT m.manifest_id, config_id, run_at, coalesce(l.status, m.status) AS status, storage_type, file_format,
              file_size_bytes, row_count, CASE WHEN l.status = 'uploaded' THEN changed_at ELSE uploaded_at END AS uploaded_at,
              CASE WHEN l.status = 'loaded' THEN changed_at ELSE loaded_at END AS loaded_at
       FROM f_manifest m LEFT JOIN last l ON m.manifest_id = l.manifest_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.set_status(derived(spark, sf, "f_manifest"), derived(spark, sf, "f_manifest_changes"))


@query(
    "manifest_register",
    """SELECT file_name, count(*) AS row_count, 'run-1' AS run_id, TIMESTAMP '2024-01-31 00:00:00' AS extracted_at,
              CAST(NULL AS TIMESTAMP) AS uploaded_at, CAST(NULL AS TIMESTAMP) AS loaded_at, 'extracted' AS status,
              TRUE AS has_size
       FROM (SELECT 'orders' AS file_name FROM orders UNION ALL SELECT 'lineitem' FROM lineitem) f GROUP BY file_name""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    def one(name: str) -> DataFrame:
        rows = manifest.register(table(spark, sf, name), "run-1", ntz(AS_OF))
        return rows.groupBy(F.lit(name).alias("file_name")).agg(
            F.sum("row_count").alias("row_count"), F.max("run_id").alias("run_id"),
            F.max("extracted_at").alias("extracted_at"), F.max("uploaded_at").alias("uploaded_at"),
            F.max("loaded_at").alias("loaded_at"), F.max("status").alias("status"),
            (F.min("file_size_bytes") > 0).alias("has_size"),
        )

    return one("orders").unionByName(one("lineitem"))


TAG = "CASE WHEN line LIKE '[%' AND contains(line, '] ') THEN substr(line, 2, instr(line, '] ') - 2) END"


@query(
    "log_by_table",
    f"""SELECT line_no, CASE WHEN named THEN tag ELSE '· general ·' END AS table_name,
               CASE WHEN named THEN substr(line, instr(line, '] ') + 2) ELSE line END AS body
        FROM (SELECT *, tag IS NOT NULL AND contains(tag, '.') AND NOT contains(tag, '/') AND NOT contains(tag, ' ') AS named
              FROM (SELECT line_no, line, {TAG} AS tag FROM f_log_lines) a) b""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "f_log_lines").withColumn("table_name", lines.tagged_table(F.col("line")))
    return rows.select("line_no", "table_name", lines.line_body(F.col("line"), F.col("table_name")).alias("body"))


@query(
    "log_severity",
    """SELECT line_no, CASE WHEN contains(l, '✅') OR contains(l, 'done') OR contains(l, 'success') OR contains(l, 'complete') THEN 'ok'
            WHEN contains(l, '❌') OR contains(l, 'failed') OR contains(l, 'error') OR contains(l, 'exception') OR contains(l, 'traceback') THEN 'error'
            WHEN contains(l, '⚠️') OR contains(l, 'warn') OR contains(l, 'skip') OR contains(l, 'no new') OR contains(l, 'drift') THEN 'warn'
            WHEN contains(l, '[full') OR contains(l, '[incr') OR contains(l, 'batch') OR contains(l, '====') OR contains(l, 'load') THEN 'info'
            ELSE 'other' END AS severity FROM (SELECT line_no, lower(line) AS l FROM f_log_lines) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "f_log_lines").select("line_no", lines.severity(F.col("line")).alias("severity"))


@query(
    "log_row_counts",
    """SELECT line_no, CASE WHEN contains(line, 'Total Rows Exported: ')
            THEN CAST(replace(trim(split_part(line, 'Total Rows Exported: ', 2)), ',', '') AS BIGINT) ELSE 0 END AS exported
       FROM f_log_lines""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "f_log_lines").select("line_no", lines.exported_rows(F.col("line")).alias("exported"))
