"""Whole runs of tables in situations that lose or repeat rows if they go wrong."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.values import ntz
from tidemark.plans.ingestion import IngestJob, run_batch
from tidemark.plans.lifecycle import Run, Table, extract, last_state, load_backlog, reconcile, run_all, run_log, stored, sync, validate
from tidemark.queries.deltas import BATCH_TS
from tidemark.queries.registry import query, table
from tidemark.session import work_path
from tidemark.sinks import files as sinks
from tidemark.sinks.tables import KeyedTable
from tidemark.sources import files, zstd
from tidemark.sources.files import FileFormat
from tidemark.streaming import ingest as streams

DAY = [datetime(2002, 1, d) for d in range(1, 10)]
# Orders as versions: the first as they are, later ones of some keys with new values and times.
BASE = "SELECT o_orderkey AS k, o_custkey AS v, o_orderdate AS updated_at FROM orders"
LATER = {
    1: "SELECT o_orderkey AS k, o_custkey + 1000 AS v, TIMESTAMP '2002-01-01 12:00:00' AS updated_at FROM orders WHERE o_orderkey % 3 = 0",
    2: "SELECT o_orderkey AS k, o_custkey + 2000 AS v, TIMESTAMP '2002-01-02 12:00:00' AS updated_at FROM orders WHERE o_orderkey % 2 = 0",
}
LAST = f"""SELECT k, arg_max(v, updated_at) AS v, max(updated_at) AS updated_at
    FROM ({BASE} UNION ALL {LATER[1]} UNION ALL {LATER[2]}) u GROUP BY k"""


def _source(spark: SparkSession, sf: str, upto: int) -> DataFrame:
    """The source table after some rounds of changes: one row per key."""
    orders = table(spark, sf, "orders")
    key, value, when = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    for n, divisor in ((1, 3), (2, 2)):
        if upto >= n:
            hit = key % divisor == 0
            value = F.when(hit, F.col("o_custkey") + 1000 * n).otherwise(value)
            when = F.when(hit, ntz(f"2002-01-0{n} 12:00:00")).otherwise(when)
    return orders.select(key.alias("k"), value.alias("v"), when.alias("updated_at"))


def _run(spark: SparkSession, root: str, batch: str, day: int, source: DataFrame | Callable[[], DataFrame], name: str = "t") -> Run:
    return Run(spark, root, batch, DAY[day], {name: source if callable(source) else lambda: source})


def _ok(record: dict) -> dict:
    if record["status"] != "success":
        raise RuntimeError(str(record))
    return record


def _rows(run: Run, setting: Table, *columns: str) -> DataFrame:
    return stored(run, setting, last_state(run, setting)[1]).read().select(*(columns or ("k", "v", "updated_at")))


@query("table_run_same_batch", LAST)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One batch id for a full load and two increments: each window is loaded."""
    root, setting = work_path(spark, "same-batch"), Table("t", ("k",), cursor_column="updated_at", buckets=8)
    for n in range(3):
        run = _run(spark, root, "b", n + 1, _source(spark, sf, n))
        _ok(sync(run, setting))
    return _rows(run, setting)


@query(
    "table_run_retry",
    f"""SELECT k, v, updated_at FROM ({LAST}) x UNION ALL
        SELECT -1, count(*), max(inserted_at) FROM (SELECT unnest([TIMESTAMP '2002-01-02 00:00:00', TIMESTAMP '2002-01-03 00:00:00',
          TIMESTAMP '2002-01-04 00:00:00']) AS inserted_at) l""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """An increment dies between its commit and its log row; the same batch is tried again after the source
    grew. Key -1 carries the log: three successes, none lost."""
    root, setting = work_path(spark, "retry"), Table("t", ("k",), cursor_column="updated_at", buckets=8)
    _ok(sync(_run(spark, root, "b1", 1, _source(spark, sf, 0)), setting))
    _ok(sync(replace(_run(spark, root, "b2", 2, _source(spark, sf, 1)), log=False), setting))
    run = _run(spark, root, "b2", 3, _source(spark, sf, 2))
    _ok(sync(run, setting))
    log = run_log(run).where("status = 'success'").agg(F.lit(-1).cast("bigint").alias("k"), F.count("*").alias("v"), F.max("inserted_at").alias("updated_at"))
    return _rows(run, setting).unionByName(log)


VERSIONS_SQL = f"""SELECT k, v, updated_at, lead(load) OVER (PARTITION BY k ORDER BY load) AS valid_to, load AS valid_from FROM (
    SELECT *, TIMESTAMP '2002-01-02 00:00:00' AS load FROM ({BASE}) a UNION ALL
    SELECT *, TIMESTAMP '2002-01-03 00:00:00' FROM ({LATER[1]}) b UNION ALL
    SELECT *, TIMESTAMP '2002-01-04 00:00:00' FROM ({LATER[2]}) c) u"""


@query("history_crash_recovery", VERSIONS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A history load whose write dies, one that dies before its log row, then a new batch: every
    version of every key is there once."""
    root, setting = work_path(spark, "history-crash"), Table("t", ("k",), scd_type=2, cursor_column="updated_at", buckets=8)
    first = _run(spark, root, "b1", 1, _source(spark, sf, 0))
    _ok(sync(first, setting))
    table_ = stored(first, setting, last_state(first, setting)[1])
    table_._write(table_._place(table_.read(), 8))  # folders of a write that never committed
    broken = _source(spark, sf, 1).withColumn("v", F.when(F.col("k") % 6 == 0, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("v")))
    if sync(_run(spark, root, "b2", 2, broken), setting)["status"] != "failed":
        raise RuntimeError("the broken source was loaded")
    _ok(sync(replace(_run(spark, root, "b2", 2, _source(spark, sf, 1)), log=False), setting))
    run = _run(spark, root, "b3", 3, _source(spark, sf, 2))
    _ok(sync(run, setting))
    return _rows(run, setting, "k", "v", "updated_at", F.col("_valid_to").alias("valid_to"), F.col("_valid_from").alias("valid_from"))


@query("stream_upsert_two_checkpoints", LAST)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams with checkpoints of their own number their batches alike; both are applied, and a
    replay of the first is not."""
    from tidemark.operators.shape import with_audit

    stored_ = KeyedTable(spark, work_path(spark, "two-streams"), ("k",), 8)
    base = _source(spark, sf, 0)
    stored_.create(with_audit(base, ntz(BATCH_TS), "b0"))
    marks = []
    for n in (1, 2):
        folder = work_path(spark, "stream-files")
        _source(spark, sf, n).where(F.col("updated_at") == ntz(f"2002-01-0{n} 12:00:00")).write.parquet(folder)
        marks.append((folder, work_path(spark, "checkpoint")))
    for folder, mark in [*marks, marks[0]]:
        streams.stream_upsert(streams.file_stream(spark, folder, base.schema), stored_, mark, BATCH_TS, "updated_at")
    return stored_.read().select("k", "v", "updated_at")


@query("table_rebucket", LAST)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The configured bucket count changes, and the key widens from int to bigint."""
    root = work_path(spark, "rebucket")
    kinds = [("int", 4), ("int", 7), ("bigint", 3)]
    for n, (kind, buckets) in enumerate(kinds):
        setting = Table("t", ("k",), cursor_column="updated_at", buckets=buckets)
        run = _run(spark, root, f"b{n}", n + 1, _source(spark, sf, n).withColumn("k", F.col("k").cast(kind)))
        _ok(sync(run, setting))
    return _rows(run, setting)


@query(
    "table_run_null_cursor",
    """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '1890-01-01 00:00:00' ELSE o_orderdate END AS updated_at,
         'time' AS cursor FROM orders
       UNION ALL SELECT CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -o_orderkey ELSE o_orderkey END, NULL, 'id' FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Null, zero, negative and very old cursors: a full load takes every row."""
    orders, root = table(spark, sf, "orders"), work_path(spark, "null-cursor")
    kind = F.col("o_orderkey") % 4
    when = F.when(kind == 1, ntz("1890-01-01 00:00:00")).when(kind != 0, F.col("o_orderdate"))
    number = F.when(kind == 1, 0).when(kind == 2, -F.col("o_orderkey")).when(kind == 3, F.col("o_orderkey"))
    sources = {
        "time": lambda: orders.select(F.col("o_orderkey").alias("k"), when.alias("updated_at"), F.lit("time").alias("cursor")),
        "id": lambda: orders.select(number.alias("k"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit("id").alias("cursor")),
    }
    settings = [Table("time", cursor_column="updated_at", buckets=4), Table("id", cursor_column="k", cursor_type="id", buckets=4)]
    run = Run(spark, root, "b1", DAY[1], sources)
    for setting in settings:
        _ok(sync(run, setting))
    a, b = (_rows(run, s, "k", "updated_at", "cursor") for s in settings)
    return a.unionByName(b)


@query(
    "run_all_log",
    """SELECT 'r' || r AS batch_id, 't' || t AS config_id, CASE r WHEN 1 THEN 'full' ELSE 'incremental' END AS load_type, 'success' AS status,
         (SELECT count(*) FROM nation WHERE n_regionkey <= r + 1 AND (r = 1 OR n_regionkey > 2)) AS rows_loaded
       FROM range(1, 3) a(r), range(0, 12) b(t)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve tables at once, twice: every table has its row in the log of each round."""
    root, settings = work_path(spark, "run-all"), [Table(f"t{i}", ("n_nationkey",), cursor_column="n_regionkey", cursor_type="id", buckets=2) for i in range(12)]
    nation = table(spark, sf, "nation")
    for r in (1, 2):
        rows = nation.where(F.col("n_regionkey") <= r + 1)
        run = Run(spark, root, f"r{r}", DAY[r], {s.config_id: lambda rows=rows: rows for s in settings})
        run_all(run, settings, at_once=12)
    return run_log(run).select("batch_id", "config_id", "load_type", "status", "rows_loaded")


@query(
    "tsv_bad_record_abort",
    """SELECT 'aborted' AS bad_value, 'aborted' AS extra_field, count_if(o_orderstatus = 'P') AS rejected, count_if(o_orderstatus <> 'P') AS kept,
         sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END)::BIGINT AS keys FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, schema = table(spark, sf, "orders"), T.StructType.fromDDL("k bigint, name string")
    bad = F.col("o_orderstatus") == "P"
    texts = {
        "bad_value": F.concat_ws("\t", F.when(bad, "2x").otherwise(F.col("o_orderkey").cast("string")), "o_orderstatus"),
        "extra_field": F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(bad, "more")),
    }
    status = {}
    for name, line in texts.items():
        path = work_path(spark, name)
        orders.select(line.alias("value")).write.text(path)
        try:
            files.read_tsv(spark, path, schema).write.parquet(work_path(spark, "tsv-target"))
            status[name] = "loaded"
        except Exception:  # raised in a task: the kind depends on where it surfaces
            status[name] = "aborted"
    kept = files.read_tsv(spark, path, schema, rejects=True)
    wrong = F.col(files.CORRUPT).isNotNull()
    return kept.agg(
        *[F.lit(s).alias(n) for n, s in status.items()], F.count_if(wrong).alias("rejected"), F.count_if(~wrong).alias("kept"),
        F.sum(F.when(~wrong, F.col("k"))).alias("keys"),
    )


@query(
    "ingest_rejects",
    """SELECT status, source_count, loaded_count, rejected_count FROM (SELECT 'FAILED' AS status, NULL::BIGINT AS source_count, NULL::BIGINT AS loaded_count,
         NULL::BIGINT AS rejected_count UNION ALL SELECT 'SUCCESS', count(*), count_if(o_orderstatus <> 'P'), count_if(o_orderstatus = 'P') FROM orders) a
       UNION ALL SELECT 'table', count(*), sum(o_orderkey)::BIGINT, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same files twice: without a place for rejects the job fails, with one it loads the rest."""
    landing, audit, rejects = (work_path(spark, n) for n in ("landing", "audit", "rejects"))
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    table(spark, sf, "orders").select("o_orderkey", price.alias("p")).write.csv(landing)
    schema, name, path = T.StructType.fromDDL("o_orderkey bigint, p double"), f"tidemark_{uuid.uuid4().hex}", work_path(spark, "loaded")
    strict = IngestJob(1, name, landing, load_mode="overwrite", table_exists=False, fmt=FileFormat(), schema=schema, table_path=path)
    run_batch(spark, [strict, replace(strict, job_id=2, rejects_path=rejects)], 1, audit)
    spark.sql(f"DROP TABLE {name}")
    told = spark.read.parquet(audit).select("status", "source_count", "loaded_count", "rejected_count")
    put = spark.read.schema(schema).parquet(path).agg(F.lit("table").alias("status"), F.count("*").alias("source_count"), F.sum("o_orderkey").alias("loaded_count"))
    rejected = spark.read.parquet(rejects).agg(F.count("*").alias("rejected_count"))
    return told.unionByName(put.withColumn("rejected_count", rejected.scalar()))


def _checked(spark: SparkSession, sf: str, value: Column, setting: Table, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Load orders with a value, then validate deeply against a changed source."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), value.alias("v"))
    run = Run(spark, work_path(spark, "believed"), "b1", DAY[1], {"t": lambda: rows})
    _ok(sync(run, setting))
    later = replace(run, sources={"t": lambda: change(rows)})
    record = validate(later, setting, deep=True)
    return rows.agg(F.lit(record["status"]).alias("status"), F.lit(record["rows_extracted"]).cast("bigint").alias("source_rows"), F.lit(record["rows_loaded"]).cast("bigint").alias("target_rows"))


COUNTS_SQL = "SELECT '{0}' AS status, count(*) AS source_rows, count(*) AS target_rows FROM orders WHERE {1}"


@query("parity_detects_duplicates", COUNTS_SQL.format("mismatch", "TRUE"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A pair of equal rows gives way to a pair of other equal rows: the XOR of hashes is the same."""
    value = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(9).cast("bigint")

    def change(rows: DataFrame) -> DataFrame:
        return rows.withColumn("v", F.when(F.col("v") == 1, F.lit(2).cast("bigint")).otherwise(F.col("v")))

    twice = Table("t", buckets=4)
    rows = table(spark, sf, "orders").select(value.alias("v"))
    run = Run(spark, work_path(spark, "believed"), "b1", DAY[1], {"t": lambda: rows})
    _ok(sync(run, twice))
    record = validate(replace(run, sources={"t": lambda: change(rows)}), twice, deep=True)
    return rows.agg(F.lit(record["status"]).alias("status"), F.lit(record["rows_extracted"]).cast("bigint").alias("source_rows"), F.lit(record["rows_loaded"]).cast("bigint").alias("target_rows"))


@query("parity_small_float_drift", COUNTS_SQL.format("mismatch", "TRUE"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Values drift by three thousandths, and some are past the fixed scale's range."""
    value = F.when(F.col("o_orderkey") % 2 == 0, F.lit(1e20)).otherwise(F.lit(1.001))
    return _checked(spark, sf, value, Table("t", ("k",), buckets=4), lambda rows: rows.withColumn("v", F.when(F.col("v") < 2, 1.004).otherwise(F.col("v"))))


@query("parity_filtered_table", COUNTS_SQL.format("success", "o_orderkey > 500"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf, F.col("o_totalprice"), Table("t", ("k",), filter="k > 500", buckets=4), lambda rows: rows)


@query(
    "table_run_filter_replace",
    f"""SELECT k, v, updated_at FROM ({BASE}) a WHERE k % 2 <> 0 UNION ALL SELECT * FROM ({LATER[2]}) b WHERE k % 6 <> 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Even keys give way to what the source now has of them, which lacks every third."""
    root = work_path(spark, "filter-replace")
    _ok(sync(_run(spark, root, "b1", 1, _source(spark, sf, 0)), Table("t", ("k",), cursor_column="updated_at", buckets=8)))
    setting = Table("t", ("k",), "filter", filter="k % 2 = 0", buckets=8)
    run = _run(spark, root, "b2", 2, _source(spark, sf, 2).where("k % 6 <> 0"))
    _ok(sync(run, setting))
    return _rows(run, setting)


@query("table_run_sql_replace", "SELECT o_custkey AS k, count(*) AS v, max(o_orderdate) AS updated_at FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The result of a query, loaded twice over."""
    root, setting = work_path(spark, "sql-replace"), Table("t", load_type="sql", buckets=8)
    orders = table(spark, sf, "orders")
    for n, rows in enumerate([orders, orders.where("o_orderstatus <> 'P'")]):
        rows.createOrReplaceTempView("tidemark_sql_replace")
        run = _run(spark, root, f"b{n}", n + 1, spark.sql("SELECT o_custkey AS k, count(*) AS v, max(o_orderdate) AS updated_at FROM tidemark_sql_replace GROUP BY o_custkey"))
        _ok(sync(run, setting))
    return _rows(run, setting)


@query(
    "table_run_multi_column",
    f"""SELECT k, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN v + 1 ELSE v END AS v, updated_at FROM ({BASE}) a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are read again if either of two columns says that they changed since the last window."""
    root, setting = work_path(spark, "multi-column"), Table("t", ("k",), change_columns=("c1", "c2"), buckets=8)
    base = _source(spark, sf, 0)
    for n in range(2):
        when = lambda divisor: F.when((F.col("k") % divisor == 0) & F.lit(n == 1), ntz("2002-01-02 12:00:00")).otherwise(ntz("2001-12-01 00:00:00"))
        changed = (F.lit(n == 1)) & (((F.col("k") % 3) == 0) | ((F.col("k") % 5) == 0) | (F.col("k") % 7 == 0))
        # keys that seven divides changed without a mark, so they keep their old value
        rows = base.withColumns({"v": F.col("v") + changed.cast("int"), "c1": when(3), "c2": when(5)})
        run = _run(spark, root, f"b{n}", n + 1 + n, rows)
        _ok(sync(run, setting))
    return _rows(run, setting)


@query("table_run_lookback", f"SELECT k, v, updated_at FROM ({BASE}) a WHERE k % 4 <> 0 OR updated_at > (SELECT max(updated_at) FROM ({BASE}) b WHERE k % 4 <> 0) - INTERVAL 90 DAY")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth row comes late; the second run reads the last ninety days again."""
    root, setting = work_path(spark, "lookback"), Table("t", ("k",), cursor_column="updated_at", lookback_minutes=90 * 24 * 60, buckets=8)
    base = _source(spark, sf, 0)
    for n, rows in enumerate([base.where("k % 4 <> 0"), base]):
        run = _run(spark, root, f"b{n}", n + 1, rows)
        _ok(sync(run, setting))
    return _rows(run, setting)


@query(
    "table_run_only_changed",
    f"""SELECT k, v, load AS valid_from, lead(load) OVER (PARTITION BY k ORDER BY load) AS valid_to FROM (
          SELECT k, v, TIMESTAMP '2002-01-02 00:00:00' AS load FROM ({BASE}) a UNION ALL
          SELECT k, v + 5, TIMESTAMP '2002-01-03 00:00:00' FROM ({BASE}) b WHERE k % 2 = 0) u""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All keys are touched, half of them with new values: only those get a version."""
    root, setting = work_path(spark, "only-changed"), Table("t", ("k",), scd_type=2, cursor_column="n", cursor_type="id", only_changed=True, buckets=8)
    base = _source(spark, sf, 0).select("k", "v")
    touched = base.withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v") + 5).otherwise(F.col("v")))
    setting = replace(setting, cursor_column=None, load_type="incremental")
    for n, rows in enumerate([base, touched]):
        run = _run(spark, root, f"b{n}", n + 1, rows)
        _ok(sync(run, setting))
    return _rows(run, setting, "k", "v", F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"))


@query(
    "table_run_backlog",
    f"""SELECT k, v, updated_at, (SELECT count(*) FROM ({LATER[1]}) a) + (SELECT count(*) FROM ({LATER[2]}) b) AS loaded, 0 AS pending FROM ({LAST}) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two windows are extracted and registered, then loaded in one pass; a second load finds nothing."""
    from tidemark.operators import manifest
    from tidemark.plans.lifecycle import files as known_files

    root, setting = work_path(spark, "backlog"), Table("t", ("k",), cursor_column="updated_at", buckets=8)
    _ok(sync(_run(spark, root, "b0", 1, _source(spark, sf, 0)), setting))
    for n in (1, 2):
        _ok(extract(_run(spark, root, f"b{n}", n + 1, _source(spark, sf, n)), setting))
    run = _run(spark, root, "b3", 4, _source(spark, sf, 2))
    loaded = _ok(load_backlog(run, setting))["rows_loaded"]
    if load_backlog(replace(run, batch_id="b4"), setting)["status"] != "skipped":
        raise RuntimeError("a loaded backlog was loaded again")
    waiting = known_files(run).where(F.col("status").isin(*manifest.PENDING)).count()
    return _rows(run, setting).withColumns({"loaded": F.lit(loaded).cast("bigint"), "pending": F.lit(waiting)})


@query("tsv_zstd_scan", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of some packed files and some that are not."""
    rows, path = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal")), work_path(spark, "tsv-zstd")
    lines = rows.select(files.tsv_line(rows).alias("value"), "c_custkey")
    lines.where("c_custkey % 3 = 0").select("value").write.text(f"{path}/plain")
    sinks.write_zstd_lines(lines.where("c_custkey % 3 <> 0").select("value"), f"{path}/packed")
    return files.read_tsv(spark, f"{path}/*", rows.schema)


@query("csv_skip_lines_pattern", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three lines before the rows of each file, and only files whose path matches."""
    orders, path = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), work_path(spark, "skip-lines")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in orders.columns])
    # each status is one file: three lines of heading sort before its rows
    heading = orders.select("o_orderstatus").distinct().select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("at"), "o_orderstatus", F.lit("a heading, not a row").alias("value"))
    body = orders.select(F.lit(9).alias("at"), "o_orderstatus", line.alias("value"))
    both = heading.unionByName(body).repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "at")
    both.withColumn("kind", F.col("o_orderstatus")).select("value", "kind").write.partitionBy("kind").text(path)
    name, place = f"tidemark_{uuid.uuid4().hex}", work_path(spark, "skipped")
    job = IngestJob(1, name, path, ".*/kind=(F|O)/.*", "overwrite", False, FileFormat(skip_header=3), orders.schema, table_path=place)
    records = run_batch(spark, [job], 1, work_path(spark, "skip-audit"))
    if [r["status"] for r in records] != ["SUCCESS"]:
        raise RuntimeError(str(records))
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(orders.schema).parquet(place)


@query("table_run_filter_then_incremental", BASE)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The source grows; a load of its even keys leaves the cursor alone, so the increment after it reads the others."""
    root, setting = work_path(spark, "filter-then"), Table("t", ("k",), cursor_column="updated_at", buckets=8)
    whole = _source(spark, sf, 0)
    _ok(sync(_run(spark, root, "b1", 1, whole.where(F.col("updated_at") < ntz("2001-01-01 00:00:00"))), setting))
    _ok(sync(_run(spark, root, "b2", 2, whole), replace(setting, load_type="filter", filter="k % 2 = 0")))
    run = _run(spark, root, "b3", 3, whole)
    _ok(sync(run, setting))
    return _rows(run, setting)


@query("table_run_text_id", f"SELECT CAST(k AS VARCHAR) AS id, v FROM ({BASE}) a")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Ids kept as text are read past the cursor as numbers: 1000 comes after 999."""
    root, setting = work_path(spark, "text-id"), Table("t", ("id",), cursor_column="id", cursor_type="id", buckets=8)
    whole = _source(spark, sf, 0).select(F.col("k").cast("string").alias("id"), "v")
    for n, upto in enumerate((9, 999, None)):
        run = _run(spark, root, f"b{n}", n + 1, whole if upto is None else whole.where(F.col("id").cast("long") <= upto))
        _ok(sync(run, setting))
    return _rows(run, setting, "id", "v")


@query(
    "table_run_emptied",
    "SELECT load_type, count(*) AS rows_before, 0 AS rows_after, 'success' AS status FROM orders, (VALUES ('full'), ('sql')) l(load_type) GROUP BY load_type",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A source that answers with no rows empties a table that is replaced whole."""
    orders, told = table(spark, sf, "orders"), []
    for kind in ("full", "sql"):
        root, setting = work_path(spark, "emptied"), Table("t", load_type=kind, buckets=4)
        before = _run(spark, root, "b1", 1, orders)
        _ok(sync(before, setting))
        rows = _rows(before, setting, "o_orderkey").agg(F.lit(kind).alias("load_type"), F.count("*").alias("rows_before"))
        after = _run(spark, root, "b2", 2, orders.where("o_orderkey < 0"))
        status = sync(after, setting)["status"]
        left = _rows(after, setting, "o_orderkey").count()
        rows = spark.createDataFrame(rows.collect(), rows.schema)  # one row: its files give way with the next load
        told.append(rows.withColumns({"rows_after": F.lit(left).cast("int"), "status": F.lit(status)}))
    return told[0].unionByName(told[1])


@query(
    "history_lookback",
    f"""SELECT k, v, updated_at, load AS valid_from, lead(load) OVER (PARTITION BY k ORDER BY load) AS valid_to FROM (
          SELECT *, TIMESTAMP '2002-01-02 00:00:00' AS load FROM ({BASE}) a UNION ALL
          SELECT *, TIMESTAMP '2002-01-04 00:00:00' FROM ({LATER[1]}) b) u""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The whole source is read again each time; only rows with new values are new versions."""
    root = work_path(spark, "history-lookback")
    setting = Table("t", ("k",), scd_type=2, cursor_column="updated_at", lookback_minutes=5 * 365 * 24 * 60, buckets=8)
    for n, upto in enumerate((0, 0, 1)):
        run = _run(spark, root, f"b{n}", n + 1, _source(spark, sf, upto))
        _ok(sync(run, setting))
    return _rows(run, setting, "k", "v", "updated_at", F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"))


@query(
    "history_filter_replace",
    f"""SELECT k, v, updated_at, TIMESTAMP '2002-01-02 00:00:00' AS valid_from, valid_to, valid_to IS NULL AS is_current FROM (
          SELECT *, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2002-01-03 00:00:00' WHEN k % 3 = 0 THEN TIMESTAMP '2002-01-04 00:00:00' END AS valid_to FROM ({BASE}) a) x
        UNION ALL SELECT *, TIMESTAMP '2002-01-03 00:00:00', NULL, TRUE FROM ({LATER[2]}) b WHERE k % 6 <> 0
        UNION ALL SELECT *, TIMESTAMP '2002-01-04 00:00:00', NULL, TRUE FROM ({LATER[1]}) c WHERE k % 2 <> 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Even keys of a history give way to what the source has of them; an increment then closes what it changes."""
    root, setting = work_path(spark, "history-filter"), Table("t", ("k",), scd_type=2, cursor_column="updated_at", only_changed=True, buckets=8)
    _ok(sync(_run(spark, root, "b1", 1, _source(spark, sf, 0)), setting))
    later = _source(spark, sf, 2).where("k % 6 <> 0")
    _ok(sync(_run(spark, root, "b2", 2, later), replace(setting, load_type="filter", filter="k % 2 = 0")))
    run = _run(spark, root, "b3", 3, later)
    _ok(sync(run, setting))
    times = (F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"), F.col("_is_current").alias("is_current"))
    return _rows(run, setting, "k", "v", "updated_at", *times)


@query(
    "csv_extra_field_abort",
    "SELECT 'aborted' AS status, count(*) AS short_rows, count_if(o_orderstatus <> 'P') AS named FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A value past the last column ends the load; rows that lack their last field are loaded."""
    orders, bad = table(spark, sf, "orders"), F.col("o_orderstatus") == "P"
    over, short = work_path(spark, "csv-over"), work_path(spark, "csv-short")
    orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(bad, "more")).alias("value")).write.text(over)
    orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(~bad, F.col("o_orderstatus"))).alias("value")).write.text(short)
    try:
        files.read_csv(spark, over, "k bigint, name string", extra_fields="fail").write.parquet(work_path(spark, "csv-target"))
        status = "loaded"
    except Exception:  # raised in a task: the kind depends on where it surfaces
        status = "aborted"
    return files.read_csv(spark, short, "k bigint, name string", extra_fields="fail").agg(
        F.lit(status).alias("status"), F.count("*").alias("short_rows"), F.count("name").alias("named")
    )


@query("tsv_zstd_frames", "SELECT o_orderkey, o_orderstatus, o_totalprice, TRUE AS several_tasks FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One packed file, read by more than one task."""
    rows, path = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), work_path(spark, "tsv-frames")
    sinks.write_zstd_lines(rows.select(files.tsv_line(rows).alias("value")).coalesce(1), path, frame_bytes=1 << 14)
    lines = zstd.read_lines(spark, [f"{path}/part-00000.tsv.zst"], task_bytes=1 << 13)
    tasks = lines.select(F.spark_partition_id().alias("p")).distinct().count()
    return files.tsv_rows(lines, rows.schema).withColumn("several_tasks", F.lit(tasks > 1))


@query("incr_scan_id_gaps", "SELECT o_orderkey + 1 AS k, o_custkey AS v FROM orders WHERE o_orderkey % 11 <> 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that are committed late are read by later runs, once each, into a table that is only appended to; ids that never
    come are looked for until they are too old."""
    root, setting = work_path(spark, "gaps"), Table("t", ("k",), scd_type=0, cursor_column="k", cursor_type="id", gap_minutes=3 * 24 * 60, buckets=8)
    whole = table(spark, sf, "orders").where("o_orderkey % 11 <> 5").select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("v"))
    late = F.when(F.col("k") > 1, F.pmod(F.xxhash64("k"), F.lit(13))).otherwise(0)  # in which run a late id is there
    most = whole.agg(F.max("k")).first()[0]
    for n, upto in enumerate((0.4, 0.7, 1.0, 1.0, 1.0)):
        run = _run(spark, root, f"b{n}", n + 1, whole.where((F.col("k") <= int(most * upto)) & (F.least(late, F.lit(4)) <= n + F.when(late > 4, 4).otherwise(0))))
        if sync(run, setting)["status"] == "failed":
            raise RuntimeError(str(run_log(run).orderBy("run_end").collect()[-1]))
    return _rows(run, setting, "k", "v")


@query(
    "reconcile_by_digest",
    """SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) AS _is_deleted, TRUE AS few_keys_moved FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Five keys are gone from the source: only keys of the buckets they lie in are compared."""
    orders, root = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), work_path(spark, "by-digest")
    setting = Table("t", ("o_orderkey",), load_type="full", buckets=64)
    first = _run(spark, root, "b1", 1, orders)
    _ok(sync(first, setting))
    gone = orders.orderBy("o_orderkey").limit(5)
    left = orders.join(gone, "o_orderkey", "left_anti")
    target = stored(first, setting, last_state(first, setting)[1])
    buckets, moved = target.differing(left)
    holding = target.touched(gone)
    few = sorted(buckets) == sorted(holding) and moved.count() + 5 == target.read_buckets(buckets).count() < orders.count() / 4
    _ok(reconcile(_run(spark, root, "b2", 2, left), setting))
    if reconcile(_run(spark, root, "b3", 3, left), setting)["rows_loaded"]:
        raise RuntimeError("gone keys were found twice")
    return _rows(first, setting, "o_orderkey", "_is_deleted").withColumn("few_keys_moved", F.lit(few))


@query(
    "run_all_log_orders",
    """SELECT 'r' || r AS batch_id, 't' || t AS config_id, CASE r WHEN 1 THEN 'full' ELSE 'incremental' END AS load_type, 'success' AS status,
         (SELECT count(*) FROM orders WHERE o_custkey % 12 = t AND CASE WHEN r = 1 THEN o_orderdate < TIMESTAMP '2001-01-01 00:00:00'
           ELSE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' END) AS rows_loaded
       FROM range(1, 3) a(r), range(0, 12) b(t)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve tables at once, each its part of the orders, in full and then by increment: every table has its row in the log of each round."""
    root, orders = work_path(spark, "run-all-orders"), table(spark, sf, "orders")
    settings = [Table(f"t{i}", ("o_orderkey",), cursor_column="o_orderdate", buckets=2) for i in range(12)]
    for r, rows in ((1, orders.where(F.col("o_orderdate") < ntz("2001-01-01 00:00:00"))), (2, orders)):
        sources = {s.config_id: lambda rows=rows, i=i: rows.where(F.col("o_custkey") % 12 == i) for i, s in enumerate(settings)}
        run_all(Run(spark, root, f"r{r}", DAY[r], sources), settings, at_once=12)
    return run_log(_run(spark, root, "r3", 3, orders)).select("batch_id", "config_id", "load_type", "status", "rows_loaded")
