"""Reading: whole tables, windows, custom SQL, files."""

from __future__ import annotations

from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.queries.registry import derived, query, table
from tidemark.session import work_path
from tidemark.sinks.files import write_quoted, write_tsv
from tidemark.sources import catalogue, files, scan

CURSOR, CEILING = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@query("full_scan", "SELECT * FROM {orders}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.full_scan(table(spark, sf, "orders"))


@query(
    "full_scan_trimmed",
    """SELECT trim(CAST(o_orderkey AS VARCHAR)) AS o_orderkey, trim(CAST(o_custkey AS VARCHAR)) AS o_custkey,
              trim(o_orderstatus) AS o_orderstatus, trim(CAST(o_orderdate AS VARCHAR)) AS o_orderdate,
              trim(o_orderpriority) AS o_orderpriority
       FROM {orders} WHERE o_orderstatus = 'F'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").drop("o_totalprice")
    return scan.full_scan(orders, "o_orderstatus = 'F'", trim=True)


@query("scan_load_type_full", "SELECT * FROM {lineitem}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(table(spark, sf, "lineitem"), scan.Scan("FULL"))


@query("scan_load_type_filter", "SELECT * FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 25")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(table(spark, sf, "lineitem"), scan.Scan("FILTER", filter="l_returnflag = 'R' AND l_quantity > 25"))


@query("incr_scan_time", f"SELECT * FROM {{events}} WHERE ts > TIMESTAMP '{CURSOR}'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.newer_than(table(spark, sf, "events"), "ts", CURSOR)


@query(
    "incr_scan_id",
    f"""SELECT * FROM {{events}}
        WHERE event_id > (SELECT max(event_id) FROM {{events}} WHERE ts <= TIMESTAMP '{CURSOR}')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    stored = events.where(F.col("ts") <= F.lit(CURSOR).cast("timestamp_ntz")).agg(F.max("event_id")).first()[0]
    return scan.newer_than(events, "event_id", stored)


@query(
    "incr_scan_time_bounded",
    f"SELECT * FROM {{events}} WHERE ts > TIMESTAMP '{CURSOR}' AND ts <= TIMESTAMP '{CEILING}'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.within(table(spark, sf, "events"), "ts", CURSOR, CEILING)


@query(
    "incr_scan_id_bounded",
    f"""SELECT * FROM {{events}}
        WHERE event_id > (SELECT max(event_id) FROM {{events}} WHERE ts <= TIMESTAMP '{CURSOR}')
          AND event_id <= (SELECT max(event_id) FROM {{events}})""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    stored = events.where(F.col("ts") <= F.lit(CURSOR).cast("timestamp_ntz")).agg(F.max("event_id")).first()[0]
    return scan.within_ids(events, "event_id", stored)


@query("partitioned_scan", "SELECT * FROM {orders}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.ranged(table(spark, sf, "orders"), "o_orderkey", 8)


@query(
    "custom_sql_source",
    """SELECT n_name, count(*) AS customers, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS balance
       FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.custom_sql(
        spark,
        """SELECT n_name, count(*) AS customers, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS balance
           FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
        {"customer": table(spark, sf, "customer"), "nation": table(spark, sf, "nation")},
    )


@query(
    "custom_sql_window",
    f"""SELECT event_id, user_id, event_type, ts FROM {{events}}
        WHERE ts >= TIMESTAMP '{CURSOR}' AND ts < TIMESTAMP '{CEILING}'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.custom_sql(
        spark,
        """SELECT event_id, user_id, event_type, ts FROM {events}
           WHERE ts >= CAST({extract_start_dttm} AS TIMESTAMP_NTZ)
             AND ts < CAST({extract_end_dttm} AS TIMESTAMP_NTZ)""",
        {"events": table(spark, sf, "events")},
        extract_start=CURSOR,
        extract_end=CEILING,
    )


@query(
    "parquet_scan_by_name",
    """SELECT o_orderkey AS "O_ORDERKEY", o_orderstatus AS "O_ORDERSTATUS", CAST(NULL AS VARCHAR) AS "O_COMMENT"
       FROM {orders}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType.fromDDL("O_ORDERKEY bigint, O_ORDERSTATUS string, O_COMMENT string")
    return files.read_by_name(spark, f"{sf}/orders.parquet", schema)


@query(
    "tsv_decode",
    """SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN '' WHEN 'assistant' THEN NULL ELSE 'a\\b' END AS note,
              CASE WHEN turn > 0 THEN DATE '2024-01-01' + CAST(turn AS INTEGER) END AS day
       FROM {conversations}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).cast("string")
    rows = table(spark, sf, "conversations").withColumns(
        {
            "note": F.when(F.col("role") == "user", "").when(F.col("role") != "assistant", "a\\b"),
            "day": F.when(F.col("turn") > 0, day).otherwise("0000-00-00"),
        }
    )
    path = work_path(spark, "tsv")
    write_tsv(rows, path)
    schema = T.StructType.fromDDL("conv_id bigint, turn bigint, role string, text string, note string, day date")
    return files.read_tsv(spark, path, schema)


@query("csv_scan", "SELECT conv_id, turn, role, nullif(text, '') AS text FROM {conversations}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    path = work_path(spark, "csv")
    write_quoted(rows, path, delimiter="|")
    return files.read_csv(spark, path, rows.schema, files.FileFormat(delimiter="|", multiline=True))


@query("csv_scan_header", "SELECT * FROM {customer}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    path = work_path(spark, "csv-header")
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, path, rows.schema, files.FileFormat(skip_header=1))


@query("csv_scan_gzip", "SELECT * FROM {part}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    path = work_path(spark, "csv-gzip")
    rows.write.option("compression", "gzip").csv(path)
    return files.read_csv(spark, path, rows.schema)


JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@query("json_scan", "SELECT * FROM {events}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    path = work_path(spark, "json")
    rows.write.options(**JSON_TIMES).json(path)
    return files.read_declared(spark, path, files.FileFormat("JSON", extras=JSON_TIMES), rows.schema)


@query("declared_format_scan", "SELECT * FROM {orders}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    times = {"timestampNTZFormat": "dd/MM/yyyy HH:mm:ss"}
    fmt = files.FileFormat("CSV", delimiter=";", quote="'", escape="\\", skip_header=1, extras=times)
    path = work_path(spark, "declared")
    rows.write.options(sep=";", quote="'", escape="\\", header=True, quoteAll=True, **times).csv(path)
    return files.read_declared(spark, path, fmt, rows.schema)


@query("pattern_scan", "SELECT * FROM {orders} WHERE o_orderstatus IN ('F', 'O')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    path = work_path(spark, "pattern")
    rows.withColumn("kind", F.col("o_orderstatus")).write.partitionBy("kind").parquet(path)
    return files.read_matching(
        lambda s: s.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(path),
        spark,
        r".*/kind=(F|O)/.*\.parquet",
    )


@query(
    "inferred_schema",
    """SELECT * FROM (VALUES (1, 'l_orderkey', 'int'), (2, 'l_partkey', 'int'), (3, 'l_suppkey', 'int'),
         (4, 'l_linenumber', 'int'), (5, 'l_quantity', 'double'), (6, 'l_extendedprice', 'double'),
         (7, 'l_discount', 'double'), (8, 'l_tax', 'double'), (9, 'l_returnflag', 'string'),
         (10, 'l_linestatus', 'string'), (11, 'l_shipdate', 'timestamp')) v(ordinal, column_name, data_type)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "infer")
    table(spark, sf, "lineitem").write.option("header", True).csv(path)
    fmt = files.FileFormat(skip_header=1, extras={"enforceSchema": "false"})
    return files.schema_rows(spark, files.read_declared(spark, path, fmt).schema)


@query("dated_path_scan", "SELECT * FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, base = table(spark, sf, "events"), work_path(spark, "dated")
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    rows.where(F.col("ts") < middle).write.parquet(files.dated_path(base, date(2024, 1, 15)))
    rows.where(F.col("ts") >= middle).write.parquet(files.dated_path(base, date(2024, 1, 31)))
    return spark.read.schema(rows.schema).parquet(files.dated_path(base, date(2024, 1, 31)))


@query(
    "src_file_lineage",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'lineitem' AS _src_file FROM {lineitem}",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.with_source_file(table(spark, sf, "lineitem"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.regexp_extract("_src_file", r"/(\w+)\.parquet", 1).alias("_src_file"),
    )


@query(
    "empty_source_guard",
    """SELECT 'after_cursor' AS source, 'loaded' AS status, count(*) AS row_count, max(ts) AS cursor
       FROM {events} WHERE ts > TIMESTAMP '2024-01-20 00:00:00'
       UNION ALL SELECT 'after_end', 'skipped', 0, max(ts) FROM {events}
       UNION ALL SELECT 'no_path', 'skipped', 0, max(ts) FROM {events}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    last = events.agg(F.max("ts")).first()[0]

    def status(name: str, rows: DataFrame | None, cursor: object) -> DataFrame:
        kept = F.lit(str(cursor)).cast("timestamp_ntz")
        if rows is None:
            return events.agg(F.lit(0).cast("bigint").alias("row_count")).select(
                F.lit(name).alias("source"), F.lit("skipped").alias("status"), "row_count", kept.alias("cursor"),
            )
        return rows.agg(F.count(F.lit(1)).alias("row_count"), F.max("ts").alias("cursor")).select(
            F.lit(name).alias("source"), F.lit("loaded").alias("status"), "row_count", "cursor"
        )

    cursor = "2024-01-20 00:00:00"
    parts = [
        status("after_cursor", files.load_or_none(lambda: scan.newer_than(events, "ts", cursor)), cursor),
        status("after_end", files.load_or_none(lambda: scan.newer_than(events, "ts", last)), last),
        status("no_path", files.load_or_none(lambda: table(spark, sf, "no_such_table")), last),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "bad_record_abort",
    """SELECT 'aborted' AS status, count_if(o_orderstatus <> 'P') AS good_rows, count_if(o_orderstatus = 'P') AS bad_rows
       FROM {orders}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    path = work_path(spark, "bad")
    table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice")).write.csv(path)
    schema = T.StructType.fromDDL("o_orderkey bigint, o_totalprice double")
    fmt = files.FileFormat()
    try:
        files.read_strict(spark, path, schema, fmt).write.parquet(work_path(spark, "bad-target"))
        status = "loaded"
    except (PySparkException, Py4JJavaError):
        status = "aborted"
    sorted_out = work_path(spark, "bad-sorted")
    files.read_with_rejects(spark, path, schema, fmt).write.parquet(sorted_out)
    bad = F.col(files.CORRUPT).isNotNull()
    return spark.read.parquet(sorted_out).agg(
        F.lit(status).alias("status"), F.count_if(~bad).alias("good_rows"), F.count_if(bad).alias("bad_rows")
    )


@query(
    "discover_tables",
    """SELECT schema_name, table_name FROM f_catalogue
       WHERE table_type = 'BASE TABLE' AND upper(schema_name) NOT IN ('MYSQL', 'SYS', 'DBC')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.user_tables(derived(spark, sf, "f_catalogue"))


@query(
    "discover_schemas",
    "SELECT DISTINCT schema_name FROM f_catalogue WHERE upper(schema_name) NOT IN ('MYSQL', 'SYS', 'DBC')",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.user_schemas(derived(spark, sf, "f_catalogue"))
