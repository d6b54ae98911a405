"""Applying deltas: dedupe, upsert, history, replace, reconcile, backlog, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.values import ntz
from tidemark.operators import apply, shape
from tidemark.queries.registry import derived, query, table
from tidemark.sources.scan import custom_sql

BATCH_TS, BATCH_ID = "2001-09-01 00:00:00", "b1"
KEYS = ["c_custkey"]
BUSINESS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, updated_at"
AUDIT_SQL = f"""TIMESTAMP '{BATCH_TS}' AS _load_ts, CAST(NULL AS VARCHAR) AS _src_file, '{BATCH_ID}' AS _batch_id,
    FALSE AS _is_deleted, CAST(NULL AS TIMESTAMP) AS _deleted_at"""
NEWEST_SQL = """row_number() OVER (PARTITION BY c_custkey ORDER BY updated_at DESC NULLS LAST, c_name DESC NULLS LAST,
    c_nationkey DESC NULLS LAST, c_acctbal DESC NULLS LAST, c_mktsegment DESC NULLS LAST)"""
LATEST_SQL = f"SELECT * FROM f_delta QUALIFY {NEWEST_SQL} = 1"
UPSERT_SQL = f"""
    SELECT {BUSINESS}, {AUDIT_SQL} FROM ({LATEST_SQL}) d
    UNION ALL
    SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target t
    WHERE NOT EXISTS (SELECT 1 FROM f_delta d WHERE d.c_custkey = t.c_custkey)"""


@query("dedupe_latest", LATEST_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.dedupe_latest(derived(spark, sf, "f_delta"), KEYS, "updated_at")


@query("scd1_upsert", UPSERT_SQL)
def scd1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return apply.upsert(
        derived(spark, sf, "f_target"), derived(spark, sf, "f_delta"), KEYS, ntz(BATCH_TS), BATCH_ID, "updated_at"
    )


LINE_ORDER = """l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST,
    l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST, l_tax DESC NULLS LAST,
    l_returnflag DESC NULLS LAST, l_linestatus DESC NULLS LAST"""
LINE_COLUMNS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus, l_shipdate"""


@query(
    "scd1_upsert_composite",
    f"""WITH old AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00'
             QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) = 1),
         new AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00'
             QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) = 1)
       SELECT {LINE_COLUMNS}, {AUDIT_SQL} FROM new
       UNION ALL
       SELECT {LINE_COLUMNS}, TIMESTAMP '2000-01-01 00:00:00', NULL, 'b0', FALSE, NULL FROM old o
       WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    lines, cut = table(spark, sf, "lineitem"), ntz("2000-01-01 00:00:00")
    loaded = apply.dedupe_latest(lines.where(F.col("l_shipdate") < cut), keys, "l_shipdate")
    target = shape.with_audit(loaded, cut, "b0")
    delta = lines.where(F.col("l_shipdate") >= cut)
    return apply.upsert(target, delta, keys, ntz(BATCH_TS), BATCH_ID, "l_shipdate")


@query(
    "scd1_keyless",
    f"""SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target
        UNION ALL SELECT {BUSINESS}, {AUDIT_SQL} FROM f_delta""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.upsert(derived(spark, sf, "f_target"), derived(spark, sf, "f_delta"), [], ntz(BATCH_TS), BATCH_ID)


@query(
    "scd0_append",
    f"""SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target
        UNION ALL SELECT {BUSINESS}, {AUDIT_SQL} FROM f_delta""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.append(derived(spark, sf, "f_target"), derived(spark, sf, "f_delta"), ntz(BATCH_TS), BATCH_ID)


SCD2_SQL = f"""WITH new AS ({LATEST_SQL})
        SELECT {BUSINESS}, CASE WHEN hit THEN TIMESTAMP '{BATCH_TS}' ELSE _load_ts END AS _load_ts, _src_file,
               CASE WHEN hit THEN '{BATCH_ID}' ELSE _batch_id END AS _batch_id, _is_deleted, _deleted_at, _valid_from,
               CASE WHEN hit THEN TIMESTAMP '{BATCH_TS}' ELSE _valid_to END AS _valid_to,
               CASE WHEN hit THEN FALSE ELSE _is_current END AS _is_current
        FROM (SELECT h.*, _is_current AND EXISTS (SELECT 1 FROM new n WHERE n.c_custkey = h.c_custkey) AS hit
              FROM f_history h) x
        UNION ALL
        SELECT {BUSINESS}, {AUDIT_SQL}, TIMESTAMP '{BATCH_TS}', CAST(NULL AS TIMESTAMP), TRUE FROM new"""


@query("scd2_apply", SCD2_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.apply_history(
        derived(spark, sf, "f_history"), derived(spark, sf, "f_delta"), KEYS, ntz(BATCH_TS), BATCH_ID, "updated_at"
    )


@query(
    "reconcile_gone_keys",
    """SELECT c_custkey FROM f_target t WHERE NOT coalesce(_is_deleted, FALSE)
       AND NOT EXISTS (SELECT 1 FROM f_source_keys s WHERE s.c_custkey = t.c_custkey)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.gone_keys(derived(spark, sf, "f_target"), derived(spark, sf, "f_source_keys"), KEYS)


@query(
    "reconcile_soft_delete",
    f"""SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, hit OR _is_deleted AS _is_deleted,
               CASE WHEN hit THEN TIMESTAMP '{BATCH_TS}' ELSE _deleted_at END AS _deleted_at
        FROM (SELECT t.*, NOT coalesce(_is_deleted, FALSE) AND NOT EXISTS
                (SELECT 1 FROM f_source_keys s WHERE s.c_custkey = t.c_custkey) AS hit FROM f_target t) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.reconcile(
        derived(spark, sf, "f_target"), derived(spark, sf, "f_source_keys"), KEYS, ntz(BATCH_TS)
    )


@query(
    "filter_replace",
    f"""SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target
        WHERE NOT coalesce(c_mktsegment = 'BUILDING' OR updated_at > TIMESTAMP '2000-06-20 00:00:00', FALSE)
        UNION ALL SELECT {BUSINESS}, {AUDIT_SQL} FROM f_delta""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.replace_where(
        derived(spark, sf, "f_target"),
        "c_mktsegment = 'BUILDING' OR updated_at > TIMESTAMP_NTZ '2000-06-20 00:00:00'",
        derived(spark, sf, "f_delta"),
        ntz(BATCH_TS),
        BATCH_ID,
    )


@query(
    "custom_sql_replace",
    f"""SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment,
               CAST(NULL AS TIMESTAMP) AS updated_at, {AUDIT_SQL}
        FROM customer WHERE c_acctbal > 500""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = custom_sql(
        spark,
        """SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment
           FROM {customer} WHERE c_acctbal > :least""",
        {"customer": table(spark, sf, "customer")},
        least=500,
    )
    return apply.replace_all(derived(spark, sf, "f_target"), rows, ntz(BATCH_TS), BATCH_ID)


BACKLOG_ORDER = """batch_no DESC, updated_at DESC NULLS LAST, c_name DESC NULLS LAST, c_nationkey DESC NULLS LAST,
    c_acctbal DESC NULLS LAST, c_mktsegment DESC NULLS LAST"""


@query(
    "backlog_apply",
    f"""SELECT {BUSINESS}, {AUDIT_SQL} FROM
          (SELECT * FROM f_backlog QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {BACKLOG_ORDER}) = 1) d
        UNION ALL
        SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target t
        WHERE NOT EXISTS (SELECT 1 FROM f_backlog d WHERE d.c_custkey = t.c_custkey)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    backlog = derived(spark, sf, "f_backlog").drop("batch_at")
    return apply.apply_backlog_upsert(
        derived(spark, sf, "f_target"), backlog, KEYS, "batch_no", ntz(BATCH_TS), BATCH_ID, "updated_at"
    )


@query(
    "backlog_history",
    f"""WITH one AS (SELECT * FROM f_backlog QUALIFY row_number() OVER (PARTITION BY c_custkey, batch_no
               ORDER BY {BACKLOG_ORDER}) = 1),
         chain AS (SELECT *, lead(batch_at) OVER (PARTITION BY c_custkey ORDER BY batch_no) AS next_at,
                          lead(batch_no) OVER (PARTITION BY c_custkey ORDER BY batch_no) AS next_no FROM one),
         fst AS (SELECT c_custkey AS k, min(batch_no) AS fno, min(batch_at) AS fat FROM f_backlog GROUP BY c_custkey)
        SELECT {BUSINESS}, coalesce(next_at, batch_at) AS _load_ts, CAST(NULL AS VARCHAR) AS _src_file,
               CAST(coalesce(next_no, batch_no) AS VARCHAR) AS _batch_id, FALSE AS _is_deleted,
               CAST(NULL AS TIMESTAMP) AS _deleted_at, batch_at AS _valid_from, next_at AS _valid_to,
               next_at IS NULL AS _is_current
        FROM chain
        UNION ALL
        SELECT {BUSINESS}, CASE WHEN hit THEN fat ELSE _load_ts END, _src_file,
               CASE WHEN hit THEN CAST(fno AS VARCHAR) ELSE _batch_id END, _is_deleted, _deleted_at, _valid_from,
               CASE WHEN hit THEN fat ELSE _valid_to END, _is_current AND NOT hit
        FROM (SELECT h.*, f.fno, f.fat, h._is_current AND f.k IS NOT NULL AS hit
              FROM f_history h LEFT JOIN fst f ON h.c_custkey = f.k) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return apply.apply_backlog_history(
        derived(spark, sf, "f_history"), derived(spark, sf, "f_backlog"), KEYS, "batch_no", "batch_at", "updated_at"
    )


@query(
    "schema_drift_report",
    """WITH src AS (SELECT table_name, upper(column_name) AS column_name FROM f_columns),
            tgt AS (SELECT table_name, upper(column_name) AS column_name FROM f_columns WHERE data_type <> 'varchar'
                    UNION ALL SELECT DISTINCT table_name, 'OLD_FLAG' FROM f_columns)
       SELECT table_name, column_name, 'added' AS change FROM (SELECT * FROM src EXCEPT SELECT * FROM tgt) a
       UNION ALL
       SELECT table_name, column_name, 'dropped' FROM (SELECT * FROM tgt EXCEPT SELECT * FROM src) b""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    source = derived(spark, sf, "f_columns")
    extra = source.select("table_name").distinct().withColumn("column_name", F.explode(F.array(F.lit("old_flag"), F.lit("_load_ts"))))
    target = source.where("data_type <> 'varchar'").select("table_name", "column_name").unionByName(extra)
    return shape.drift_report(source, target)


@query(
    "schema_drift_apply",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, updated_at, CAST(NULL AS VARCHAR) AS c_phone,
              CAST(NULL AS INTEGER) AS c_rank, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target t
       WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = t.c_custkey)
       UNION ALL
       SELECT c_custkey, c_name, CAST(NULL AS INTEGER), CAST(NULL AS DECIMAL(18,2)), c_mktsegment,
              CAST(NULL AS TIMESTAMP), concat('p', CAST(c_custkey AS VARCHAR)), c_nationkey,
              TIMESTAMP '2001-09-01 00:00:00', NULL, 'b1', FALSE, NULL
       FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    delta = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("c_phone"),
        F.col("c_nationkey").alias("c_rank"),
    )
    target = shape.widen(derived(spark, sf, "f_target"), delta)
    return apply.upsert(target, delta, KEYS, ntz(BATCH_TS), BATCH_ID)
