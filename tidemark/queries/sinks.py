"""Writing and reading back."""

from __future__ import annotations

import math
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.values import ntz
from tidemark.operators import apply, runlog
from tidemark.operators.shape import with_audit
from tidemark.plans.ingestion import IngestJob, run_batch
from tidemark.plans.lifecycle import Run, Table, last_state, reconcile, sync
from tidemark.plans.lifecycle import stored as lifecycle_table
from tidemark.queries.deltas import AUDIT_SQL, BATCH_ID, BATCH_TS, BUSINESS, KEYS, SCD2_SQL, UPSERT_SQL
from tidemark.queries.registry import derived, query, table
from tidemark.session import work_path
from tidemark.sinks import files as out
from tidemark.sinks import tables
from tidemark.sources import files as read

ROWS = 5000
PART_BYTES = 2**16


@query(
    "sink_rows_per_file",
    f"SELECT count(*) AS total_rows, 0 AS files_over_limit, TRUE AS enough_files FROM lineitem HAVING count(*) > {ROWS}",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "rows-per-file")
    out.write_rows_per_file(table(spark, sf, "lineitem"), path, ROWS)
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("total_rows"),
        F.count_if(F.col("n") > ROWS).alias("files_over_limit"),
        (F.count(F.lit(1)) * ROWS >= F.sum("n")).alias("enough_files"),
    )


@query("sink_csv_gzip_parts", "SELECT * FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = table(spark, sf, "lineitem"), work_path(spark, "gzip-parts")
    out.write_sized_parts(rows, path, PART_BYTES * 16, header=False, gzip=True)
    return read.read_csv(spark, path, rows.schema)


@query("sink_sized_parts", "SELECT * FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = table(spark, sf, "customer"), work_path(spark, "sized-parts")
    out.write_sized_parts(rows, path, PART_BYTES, header=True)
    return read.read_csv(spark, path, rows.schema, read.FileFormat(skip_header=1))


@query("sink_csv_quoted", "SELECT page_id, nullif(url, '') AS url, nullif(html, '') AS html FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = table(spark, sf, "pages"), work_path(spark, "quoted")
    out.write_quoted(rows, path, delimiter="\x01")
    return read.read_csv(spark, path, rows.schema, read.FileFormat(delimiter="\x01", multiline=True))


APPEND_SQL = f"""SELECT {BUSINESS}, _load_ts, _src_file, _batch_id, _is_deleted, _deleted_at FROM f_target
    UNION ALL SELECT {BUSINESS}, {AUDIT_SQL} FROM f_delta"""


@query("write_append", APPEND_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    target, path = derived(spark, sf, "f_target"), work_path(spark, "append")
    tables.write_path(target, path, "error")
    new = apply.append(target.limit(0), derived(spark, sf, "f_delta"), ntz(BATCH_TS), BATCH_ID)
    tables.write_path(new, path, "append")
    return spark.read.schema(target.schema).parquet(path)


@query("write_overwrite", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, path = table(spark, sf, "orders"), work_path(spark, "overwrite")
    name = f"tidemark_{uuid.uuid4().hex}"
    tables.write_table(orders, name, "overwrite", path)
    tables.write_table(orders.where("o_orderstatus = 'O'"), name, "overwrite", path)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(orders.schema).parquet(path)


@query("create_empty_like", "SELECT 0 AS rows_before, 6 AS column_count, count(*) AS rows_after FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """An empty table in the shape of the orders, then the orders appended to it."""
    orders, path = table(spark, sf, "orders"), work_path(spark, "empty")
    tables.create_empty(spark, orders.schema, path)
    empty = spark.read.parquet(path)
    before, width = empty.count(), len(empty.columns)
    tables.write_path(orders, path, "append")
    return spark.read.parquet(path).agg(
        F.lit(before).alias("rows_before"), F.lit(width).alias("column_count"), F.count(F.lit(1)).alias("rows_after")
    )


@query("append_requires_table", "SELECT 'refused' AS status, count(*) AS rows_waiting FROM f_delta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    delta = derived(spark, sf, "f_delta")
    try:
        tables.write_table(delta, f"tidemark_{uuid.uuid4().hex}", "append")
        status = "appended"
    except tables.MissingTableError:
        status = "refused"
    return delta.agg(F.lit(status).alias("status"), F.count(F.lit(1)).alias("rows_waiting"))


REPLACED_SQL = f"SELECT {BUSINESS}, {AUDIT_SQL} FROM f_delta"


@query("full_replace", REPLACED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    target, path = derived(spark, sf, "f_target"), work_path(spark, "replace")
    tables.write_path(target, path, "error")
    fresh = apply.replace_all(target, derived(spark, sf, "f_delta"), ntz(BATCH_TS), BATCH_ID)
    tables.write_path(fresh, path, "overwrite")
    return spark.read.schema(target.schema).parquet(path)


@query("full_replace_atomic", REPLACED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    target, base = derived(spark, sf, "f_target"), work_path(spark, "replace-atomic")
    name = f"tidemark_{uuid.uuid4().hex}"
    tables.replace_table(target, name, base)
    fresh = apply.replace_all(target, derived(spark, sf, "f_delta"), ntz(BATCH_TS), BATCH_ID)
    place = tables.replace_table(fresh, name, base)
    seen = spark.table(name).schema
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return spark.read.schema(seen).parquet(place)


@query("keyed_table_upsert", UPSERT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.KeyedTable(spark, work_path(spark, "keyed"), tuple(KEYS), 16)
    stored.create(derived(spark, sf, "f_target"))
    stored.apply(
        derived(spark, sf, "f_delta"),
        lambda t, d, small: apply.upsert(t, d, KEYS, ntz(BATCH_TS), BATCH_ID, "updated_at", small=small),
        BATCH_ID,
    )
    return stored.read()


@query(
    "audit_promote",
    """WITH b AS (SELECT max(batch_id) AS n FROM f_run_log)
       SELECT l.* FROM f_run_log l, b WHERE l.batch_id = b.n UNION ALL SELECT l.* FROM f_run_log l, b WHERE l.batch_id < b.n""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = derived(spark, sf, "f_run_log")
    last = log.agg(F.max("batch_id")).first()[0]
    return runlog.promote(log, log.where(F.col("batch_id") < last), last)


@query(
    "run_log_append",
    """SELECT run_no, table_no, status, inserted_at FROM f_run_log
       UNION ALL SELECT (SELECT max(run_no) FROM f_run_log) + 1, table_no, 'success', TIMESTAMP '2024-01-31 00:00:00'
       FROM f_run_log GROUP BY table_no""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log, path = derived(spark, sf, "f_run_log"), work_path(spark, "run-log")
    log = log.select("run_no", "table_no", "status", "inserted_at")
    tables.write_path(log, path, "error")
    last = log.agg(F.max("run_no") + 1)
    batch = log.groupBy("table_no").agg(F.lit("success").alias("status")).select(
        last.scalar().alias("run_no"), "table_no", "status", ntz("2024-01-31 00:00:00").alias("inserted_at")
    )
    tables.write_path(batch, path, "append")
    return spark.read.schema(log.schema).parquet(path)


@query(
    "file_ingest",
    """SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs over one landing folder: the first creates the table, the second appends."""
    orders, landing = table(spark, sf, "orders"), work_path(spark, "landing")
    times = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    orders.withColumn("kind", F.col("o_orderstatus")).write.partitionBy("kind").options(header=True, **times).csv(landing)
    name, path = f"tidemark_{uuid.uuid4().hex}", work_path(spark, "ingested")
    fmt = read.FileFormat(skip_header=1, extras=times)
    jobs = [
        IngestJob(1, name, landing, ".*/kind=(F|O)/.*", "overwrite", False, fmt, orders.schema, table_path=path),
        IngestJob(2, name, landing, ".*/kind=P/.*", "append", True, fmt, orders.schema, table_path=path),
    ]
    records = run_batch(spark, jobs, 10_000, work_path(spark, "ingest-audit"))
    if [r["status"] for r in records] != ["SUCCESS", "SUCCESS"]:
        raise RuntimeError(str(records))
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(orders.schema).parquet(path)


@query("keyed_table_history", SCD2_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.KeyedTable(spark, work_path(spark, "keyed-history"), tuple(KEYS), 16, "NOT _is_current")
    stored.create(derived(spark, sf, "f_history"))
    stored.apply(
        derived(spark, sf, "f_delta"),
        lambda t, d, small: apply.apply_history(t, d, KEYS, ntz(BATCH_TS), BATCH_ID, "updated_at", small=small),
        BATCH_ID,
    )
    return stored.read()


@query(
    "table_run",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
              CASE WHEN o_orderdate < TIMESTAMP '2001-01-01 00:00:00' THEN 'b1' ELSE 'b2' END AS _batch_id,
              o_orderstatus = 'P' AS _is_deleted,
              CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2001-09-02 00:00:00' END AS _deleted_at FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A full run, an incremental run and a reconcile of one table."""
    orders, root = table(spark, sf, "orders"), work_path(spark, "table-run")
    setting = Table("orders", ("o_orderkey",), cursor_column="o_orderdate", buckets=8)
    days = {
        "b1": (datetime(2001, 1, 2), orders.where(F.col("o_orderdate") < ntz("2001-01-01 00:00:00")), sync),
        "b2": (datetime(2001, 9, 1), orders, sync),
        "b3": (datetime(2001, 9, 2), orders.where("o_orderstatus <> 'P'"), reconcile),
    }
    for batch, (as_of, source, step) in days.items():
        run = Run(spark, root, batch, as_of, {"orders": lambda rows=source: rows})
        record = step(run, setting)
        if record["status"] != "success":
            raise RuntimeError(str(record))
    return lifecycle_table(run, setting, last_state(run, setting)[1]).read().select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "_batch_id", "_is_deleted", "_deleted_at"
    )


@query(
    "sink_part_sizes",
    f"""SELECT count(*) AS total_rows, sum(strlen(doc_id::VARCHAR || ' ' || replace(coalesce(text, ''), chr(10), ' ')) + 1)::BIGINT AS total_bytes,
          0 AS parts_over_limit, TRUE AS parts_are_full FROM documents HAVING count(*) > 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of very unequal width: no file is over its limit unless it is one line, and no two of a task would fit in one."""
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    path = work_path(spark, "rolling")
    out.write_rolling(table(spark, sf, "documents").select(line.alias("value")), path, PART_BYTES)
    parts = out.read_manifest(spark, path)
    found = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("read"))
    both = parts.join(found, "name", "left")
    task = F.substring("name", 1, 10)
    after = F.lead("bytes").over(Window.partitionBy(task).orderBy("name"))
    both = both.withColumn("together", F.col("bytes") + after)
    return both.agg(
        F.sum(F.when(F.col("rows") == F.col("read"), F.col("rows"))).alias("total_rows"), F.sum("bytes").alias("total_bytes"),
        F.count_if((F.col("bytes") > PART_BYTES) & (F.col("rows") > 1)).cast("int").alias("parts_over_limit"),
        F.coalesce(F.min(F.col("together")) > PART_BYTES, F.lit(True)).alias("parts_are_full"),
    )


@query(
    "keyed_table_sparse_delta",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 1500 = 7 THEN o_custkey + 2 ELSE o_custkey END AS v, TRUE AS few_files, TRUE AS others_stay FROM orders
       UNION ALL SELECT -o_orderkey, o_custkey, TRUE, TRUE FROM orders WHERE o_orderkey % 1500 = 7""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two deltas of few keys, changed and new ones: only files that hold a key are rewritten (a tenth more at most), others of the
    touched buckets stay."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    stored = tables.KeyedTable(spark, work_path(spark, "sparse"), ("k",), 4, file_rows=200, file_bytes=1 << 12, prune_from=0)
    stored.create(with_audit(orders, ntz(BATCH_TS), "b0"))
    few, stay = True, True
    for n in (1, 2):
        hit = orders.where("k % 1500 = 7")
        delta = hit.withColumn("v", F.col("v") + n).unionByName(hit.withColumn("k", -F.col("k")))
        version = stored.version()
        holding = stored._rows(version.schema, version.files, named=True).join(delta.select("k"), "k", "left_semi").select("_bucket", "_file").distinct().count()
        did = stored.apply(delta, lambda t, d, small: apply.upsert(t, d, ["k"], ntz(BATCH_TS), BATCH_ID, small=small), f"b{n}")
        few, stay = few and did.rewritten <= 1.1 * holding, stay and did.left > 0
    return stored.read().select("k", "v", F.lit(few).alias("few_files"), F.lit(stay).alias("others_stay"))


@query("append_compaction", "SELECT o_orderkey, o_totalprice, TRUE AS few_folders, TRUE AS short_versions FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty appends leave folders by the logarithm of their number, and version files that name changes only."""
    orders, n, fan = table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 30, 4
    stored = tables.KeyedTable(spark, work_path(spark, "compaction"), (), fan=fan)
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(n + 1))
    stored.create(orders.where(part == 0))
    for i in range(1, n + 1):
        stored.add(orders.where(part == i), f"b{i}")
    version = stored.version()
    bound = (fan - 1) * (2 + math.log(n, fan))
    few, short = len(version.folders) <= bound, len(version.tail) < n and sum(len(f) for f in version.files.values()) <= 4 * bound * spark.sparkContext.defaultParallelism
    return stored.read().withColumns({"few_folders": F.lit(few), "short_versions": F.lit(short)})
