"""Decisions over configuration and metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import typemap
from tidemark.plans import config as plans
from tidemark.queries.registry import derived, query
from tidemark.sources import catalogue


@query("active_jobs", "SELECT * FROM f_config WHERE active")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return plans.active_jobs(derived(spark, sf, "f_config"))


WHOLE_SQL = "coalesce(lower(k.data_type) IN ('int', 'integer', 'bigint', 'smallint', 'mediumint', 'tinyint'), FALSE)"
CURSOR_SQL = f"""SELECT c.*, upper(CASE WHEN watermark_type = 'id' THEN coalesce(watermark_col, primary_key)
        WHEN watermark_type = 'time' THEN watermark_col WHEN watermark_col IS NOT NULL THEN watermark_col
        WHEN {WHOLE_SQL} THEN primary_key END) AS cursor_col,
        coalesce(watermark_type, CASE WHEN {WHOLE_SQL} THEN 'id' ELSE 'time' END) AS cursor_type
    FROM f_config c LEFT JOIN f_columns k
      ON c.source_table = k.table_name AND lower(coalesce(c.watermark_col, c.primary_key)) = lower(k.column_name)"""


@query("cursor_resolution", CURSOR_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return plans.resolve_cursors(derived(spark, sf, "f_config"), derived(spark, sf, "f_columns"))


@query(
    "load_plan",
    f"""SELECT *, CASE WHEN lower(load_type) = 'full' OR (cursor_type = 'id' AND last_loaded_key IS NULL)
                OR (cursor_type <> 'id' AND last_loaded_at IS NULL) THEN 'full' ELSE 'incremental' END AS plan
        FROM ({CURSOR_SQL}) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    jobs = plans.resolve_cursors(derived(spark, sf, "f_config"), derived(spark, sf, "f_columns"))
    return plans.load_plan(jobs)


@query(
    "effective_keys",
    """SELECT config_id, upper(CASE WHEN coalesce(merge_keys_text, '') <> '' THEN merge_keys_text
              ELSE coalesce(primary_key, '') END) AS keys FROM f_config""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.filter(F.split(F.coalesce("merge_keys_text", F.lit("")), ","), lambda k: k != "")
    rows = plans.effective_keys(derived(spark, sf, "f_config").withColumn("merge_keys", listed))
    return rows.select("config_id", F.array_join("keys", ",").alias("keys"))


@query(
    "insert_only_merge",
    """SELECT config_id, source_db, source_table, load_type FROM f_config WHERE active
       UNION ALL SELECT config_id, source_db, source_table, 'full' FROM f_config WHERE NOT active""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    config = derived(spark, sf, "f_config").select("config_id", "source_db", "source_table", "load_type", "active")
    found = config.withColumn("load_type", F.lit("full")).drop("active")
    return plans.insert_only(config.where("active").drop("active"), found, ["source_db", "source_table"])


@query(
    "partial_update",
    """SELECT c.config_id, c.source_table, coalesce(n.load_type, c.load_type) AS load_type,
              CASE WHEN n.orders > 12 THEN NULL ELSE coalesce(n.watermark_col, c.watermark_col) END AS watermark_col
       FROM f_config c LEFT JOIN
         (SELECT o_custkey, count(*) AS orders, CASE WHEN max(o_totalprice) > 400000 THEN 'incremental' END AS load_type,
                 CASE WHEN min(o_totalprice) > 20000 THEN 'ts' END AS watermark_col
          FROM orders GROUP BY o_custkey) n ON c.config_id = n.o_custkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    changes = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("config_id")).agg(
        F.when(F.max("o_totalprice") > 400000, "incremental").alias("load_type"),
        F.when(F.min("o_totalprice") > 20000, "ts").alias("watermark_col"),
        F.when(F.count(F.lit(1)) > 12, F.array(F.lit("watermark_col"))).alias("clear"),
    )
    rows = derived(spark, sf, "f_config").select("config_id", "source_table", "load_type", "watermark_col")
    return plans.partial_update(rows, changes, "config_id", ["load_type", "watermark_col"], ["watermark_col"])


@query(
    "cursor_advance",
    """SELECT c.config_id, CASE WHEN r.status = 'success' THEN greatest(c.last_loaded_at, r.new_cursor) ELSE c.last_loaded_at END AS last_loaded_at,
              coalesce(r.status, c.last_run_status) AS last_run_status
       FROM f_config c LEFT JOIN
         (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'success' END, event_id) AS status,
                 max(ts) AS new_cursor FROM events GROUP BY user_id) r ON c.config_id = r.user_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("success")
    results = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("config_id")).agg(
        F.max_by(status, "event_id").alias("status"), F.max("ts").alias("new_cursor")
    )
    cursors = derived(spark, sf, "f_config").select("config_id", "last_loaded_at", "last_run_status")
    return plans.advance_cursors(cursors, results)


NAMES_SQL = "['updated_at', 'modified_at', 'last_modified', 'updated_on', 'created_at', 'created_on']"


@query(
    "propose_load_config",
    f"""WITH g AS (SELECT table_name,
              arg_min(upper(column_name), rank) FILTER (WHERE rank > 0 AND data_type IN ('datetime', 'timestamp', 'date')) AS wm,
              count(key_position) AS n,
              arg_min(upper(column_name), key_position) AS first_key,
              string_agg(CASE WHEN key_position IS NOT NULL THEN upper(column_name) END, ', ' ORDER BY key_position) AS keys
            FROM (SELECT *, list_position({NAMES_SQL}, lower(column_name)) AS rank FROM f_columns) c GROUP BY table_name)
        SELECT table_name, first_key AS primary_key, CASE WHEN n > 1 THEN keys END AS merge_keys, wm AS watermark_col,
               CASE WHEN wm IS NOT NULL AND n > 0 THEN 'incremental' ELSE 'full' END AS load_type,
               CASE WHEN n = 1 THEN first_key END AS partition_col, CASE WHEN n > 0 THEN 8 ELSE 1 END AS partition_num,
               nullif(concat_ws('; ', CASE WHEN n = 0 THEN 'no primary key — full load only' END,
                     CASE WHEN n > 1 THEN 'composite key (' || keys || ')' END,
                     CASE WHEN wm IS NULL THEN 'no watermark column detected' END), '') AS review
        FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = plans.propose_load(derived(spark, sf, "f_columns"))
    return rows.withColumn("merge_keys", F.array_join("merge_keys", ", "))


@query(
    "column_ordinals",
    """SELECT table_name, column_id, column_name,
              row_number() OVER (PARTITION BY table_name ORDER BY column_id, column_name) AS ordinal FROM f_codes""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "f_codes").select("table_name", "column_id", "column_name")
    return catalogue.column_ordinals(rows, ["table_name"], "column_id", ["column_name"])


@query(
    "column_index_metadata",
    """SELECT c.table_name, c.column_id, c.column_name, i.index_type,
              CASE i.index_type WHEN 'P' THEN 'Nonpartitioned primary index' WHEN 'K' THEN 'Primary key' END AS index_type_name
       FROM f_columns c LEFT JOIN (SELECT table_name, column_name, CASE key_position WHEN 1 THEN 'P' ELSE 'K' END AS index_type
              FROM f_columns WHERE key_position IS NOT NULL) i
         ON c.table_name = i.table_name AND c.column_name = i.column_name""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    columns = derived(spark, sf, "f_columns").select("table_name", "column_id", "column_name", "key_position")
    indexes = columns.where("key_position IS NOT NULL").select(
        "table_name", "column_name", F.when(F.col("key_position") == 1, "P").otherwise("K").alias("index_type")
    )
    joined = catalogue.with_indexes(columns.drop("key_position"), indexes, ("table_name", "column_name"))
    return joined.withColumn("index_type_name", typemap.index_kind(F.col("index_type")))
