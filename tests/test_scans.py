"""Pushdown, pruning, cursors, JDBC options, discovery, type mapping branches."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from tidemark.functions import logs, typemap
from tidemark.functions.values import freshness, ntz, time_ceiling
from tidemark.operators import apply, manifest
from tidemark.plans import config as plans
from tidemark.queries import QUERIES
from tidemark.session import settings_for
from tidemark.sources import catalogue, jdbc, scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@pytest.mark.parametrize(
    "read, wanted",
    [
        (lambda e: scan.newer_than(e, "ts", "2024-01-10 00:00:00"), "GreaterThan(ts,"),
        (lambda e: scan.within(e, "event_id", 5, 9), "LessThanOrEqual(event_id,9)"),
        (lambda e: scan.changed_between(e, ["ts"], "2024-01-10", "2024-01-11"), "GreaterThanOrEqual(ts,"),
        (lambda e: scan.id_changed_after(e, "event_id", 7), "GreaterThan(event_id,7)"),
        (lambda e: scan.with_lookback(e, "ts", "2024-01-10 00:00:00", 5, "2024-01-11 00:00:00"), "GreaterThan(ts,"),
        (lambda e: scan.scan(e, scan.Scan("FULL", filter="event_type = 'click'")), "EqualTo(event_type,click)"),
    ],
)
def test_windows_reach_the_scan(spark, sf_dir, read, wanted):
    df = read(events(spark, sf_dir))
    leaf = df._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert wanted in leaf.metadata().apply("PushedFilters")


def test_reconcile_reads_only_key_columns_to_find_gone_rows(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    target = orders.withColumn("_is_deleted", F.lit(False))
    leaves = apply.gone_keys(target, orders, ["o_orderkey"])._jdf.queryExecution().sparkPlan().collectLeaves()
    for i in range(leaves.size()):
        assert leaves.apply(i).metadata().apply("ReadSchema") == "struct<o_orderkey:bigint>"


@pytest.mark.parametrize("name", ["scd1_upsert", "scd2_apply", "reconcile_soft_delete", "backlog_history", "parity_count",
                                  "next_batch_id", "cursor_resolution", "manifest_retention", "schema_drift_report"])
def test_no_all_pairs_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_settings(spark):
    rows = spark.createDataFrame([(1, " a ", 5), (2, "b", 9)], "id int, t string, n int")
    inc = scan.Scan("INCREMENTAL", filter="n < 100", cursor_column="id", cursor_type="id")
    assert [r.id for r in scan.scan(rows, inc, 1, 2).collect()] == [2]
    assert scan.scan(rows, inc, None, 2).count() == 2
    assert [r.t for r in scan.scan(rows, scan.Scan(trim=True, columns=("t",))).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        scan.scan(rows, scan.Scan("FILTER"))


def test_change_columns_any_of(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", None), (2, None, "2024-01-05"), (3, None, None)], "i int, a string, b string")
    rows = rows.select("i", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    assert [r.i for r in scan.changed_between(rows, ["a", "b"], "2024-01-01", "2024-01-05").collect()] == [1]
    assert [r.i for r in scan.changed_after(rows, ["a", "b"], "2024-01-01").collect()] == [2]
    assert scan.changed_after(rows, [], "2024-01-01").count() == 3


def test_time_ceiling():
    assert time_ceiling("2024-01-31 00:00:00") == datetime(2024, 1, 30, 23, 59)


def test_jdbc_options():
    t = jdbc.JdbcTable("jdbc:x", "db.t", "drv", partition_column="id", partitions=8)
    assert jdbc.bounds_query(t) == "(SELECT MIN(id) AS low, MAX(id) AS high FROM db.t) b"
    assert jdbc.greatest_query(t, "id") == "(SELECT MAX(id) AS high FROM db.t) m"
    ranged = jdbc.read_options(t, T.LongType(), 1, 100)
    assert ranged["preferTimestampNTZ"] == "true"
    assert (ranged["partitionColumn"], ranged["lowerBound"], ranged["numPartitions"]) == ("id", "1", "8")
    assert "partitionColumn" not in jdbc.read_options(t, T.StringType(), 1, 100)
    assert "partitionColumn" not in jdbc.read_options(t, T.LongType(), None, None)
    assert jdbc.JdbcTable("u", "t", query="SELECT 1").relation == "(SELECT 1) q"
    assert jdbc.custom_schema({"a": 65, "b": 12}) == "a STRING"


def test_mysql_types(spark):
    rows = [
        ("tinyint", "tinyint(1)", 3, 0, None, "BOOLEAN"), ("tinyint", "tinyint(4)", 3, 0, None, "NUMBER(38,0)"),
        ("decimal", "", 39, 2, None, "VARCHAR"), ("decimal", "", None, None, None, "NUMBER(38,0)"),
        ("NUMERIC", "", 10, 3, None, "NUMBER(10,3)"), ("json", "", None, None, None, "VARIANT"),
        ("char", "", None, None, 0, "VARCHAR(16777216)"), ("varchar", "", None, None, 20, "VARCHAR(20)"),
        (None, None, None, None, None, "VARCHAR(16777216)"), ("blob", "", None, None, 9, "BINARY"),
    ]
    df = spark.createDataFrame(rows, "d string, c string, p int, s int, n bigint, want string")
    got = df.withColumn("got", typemap.mysql_type(*[F.col(x) for x in "dcpsn"]))
    assert [(r.d, r.got) for r in got.where("NOT got <=> want").collect()] == []


def test_spark_types(spark):
    names = ["NUMBER(38,0)", "NUMBER(12,2)", "BOOLEAN", "TIMESTAMP_TZ", "VARCHAR(3)", "TIME", "VARIANT", "BINARY"]
    df = spark.createDataFrame([(n,) for n in names], "t string").select("t", typemap.spark_type_text(F.col("t")).alias("s"))
    assert [(r.t, r.s) for r in df.collect()] == [(n, typemap.spark_type(n)) for n in names]
    assert typemap.spark_type("NUMBER(12,2)") == "decimal(12,2)"


def test_log_lines(spark):
    df = spark.createDataFrame(
        [("[a.b] load done",), ("[x/y.z] Failed",), ("[no tag",), ("Total Rows Exported:  1,234",), ("plain",)], "l string"
    )
    line = F.col("l")
    got = df.select(logs.tagged_table(line).alias("t"), logs.severity(line).alias("s"), logs.exported_rows(line).alias("n"))
    assert [tuple(r) for r in got.collect()] == [
        ("a.b", "ok", 0), (logs.GENERAL, "error", 0), (logs.GENERAL, "other", 0), (logs.GENERAL, "other", 1234),
        (logs.GENERAL, "other", 0),
    ]


def test_freshness(spark):
    rows = [("2024-01-01 11:30:00", "30m ago"), ("2024-01-01 09:00:00", "3.0h ago"), ("2023-12-30 00:00:00", "2.5d ago"), (None, "Never")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = df.select("want", freshness(F.col("t"), ntz("2024-01-01 12:00:00")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_cursor_rules(spark):
    config = spark.createDataFrame(
        [("a", None, "id", "pk1"), ("b", "wm", None, None), ("c", None, None, "pk1"), ("d", "num", None, None), ("e", None, "time", "pk1")],
        "source_table string, watermark_col string, watermark_type string, primary_key string",
    )
    columns = spark.createDataFrame(
        [("b", "WM", "datetime"), ("c", "pk1", "bigint"), ("d", "num", "int")], "table_name string, column_name string, data_type string"
    )
    got = {r.source_table: (r.cursor_col, r.cursor_type) for r in plans.resolve_cursors(config, columns).collect()}
    assert got == {"a": ("PK1", "id"), "b": ("WM", "time"), "c": ("PK1", "id"), "d": ("NUM", "id"), "e": (None, "time")}


def test_proposals(spark):
    columns = spark.createDataFrame(
        [("t", "id", "int", 1), ("t", "created_at", "date", None), ("t", "updated_at", "varchar", None), ("u", "x", "int", None),
         ("v", "b", "int", 2), ("v", "a", "int", 1), ("v", "Modified_At", "timestamp", None)],
        "table_name string, column_name string, data_type string, key_position int",
    )
    got = {r.table_name: r for r in plans.propose_load(columns).collect()}
    assert (got["t"].watermark_col, got["t"].load_type, got["t"].partition_col, got["t"].review) == ("CREATED_AT", "incremental", "ID", None)
    assert (got["u"].load_type, got["u"].partition_num) == ("full", 1)
    assert got["u"].review == f"{plans.NO_KEY_NOTE}; {plans.NO_WATERMARK_NOTE}"
    assert (got["v"].merge_keys, got["v"].watermark_col, got["v"].review) == (["A", "B"], "MODIFIED_AT", "composite key (A, B)")


def test_partial_update_keeps_unset_fields_and_clears_named_ones(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, f string, g string")
    changes = spark.createDataFrame([(1, None, None, ["g"])], "id int, f string, g string, clear array<string>")
    got = plans.partial_update(table, changes, "id", ["f", "g"], ["g"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", None), (2, "b", "y")]


def test_cursor_never_moves_back(spark):
    cursors = spark.createDataFrame([(1, "2024-01-05", "success"), (2, "2024-01-05", None), (3, None, None)], "config_id int, last_loaded_at string, last_run_status string")
    results = spark.createDataFrame([(1, "success", "2024-01-01"), (2, "failed", "2024-02-01"), (3, "success", "2024-02-01")], "config_id int, status string, new_cursor string")
    got = {r.config_id: (r.last_loaded_at, r.last_run_status) for r in plans.advance_cursors(cursors, results).collect()}
    assert got == {1: ("2024-01-05", "success"), 2: ("2024-01-05", "failed"), 3: ("2024-02-01", "success")}


def test_failed_step_is_kept_until_a_success(spark):
    cursors = spark.createDataFrame(
        [(1, 5, "r0", "load", "failed"), (2, 5, "r0", None, None), (3, 5, "r0", "merge", "failed")],
        "config_id int, last_loaded_key int, last_run_id string, last_failed_step string, last_run_status string",
    )
    results = spark.createDataFrame(
        [(1, "success", 9, "r1", None), (2, "failed", 9, "r1", "extract")],
        "config_id int, status string, new_key int, run_id string, failed_step string",
    )
    got = {r.config_id: tuple(r)[1:] for r in plans.advance_cursors(cursors, results).collect()}
    assert got == {1: (9, "r1", None, "success"), 2: (5, "r1", "extract", "failed"), 3: (5, "r0", "merge", "failed")}


def test_settings_grow_with_the_data():
    small, large = settings_for(10**9), settings_for(10**14)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert large["spark.sql.shuffle.partitions"] == "50000"


def test_range_read_splits_a_hot_value(spark):
    rows = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("v")
    )
    spread = scan.ranged(rows, "k", 8)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 8_000
    assert scan.ranged(rows, "v", 8) is rows


def test_ordinals_over_many_blocks_equal_a_plain_ranking(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("t"),
        (F.col("id") * 37 % 211).alias("column_id"), F.col("id").cast("string").alias("c"),
    )
    got = catalogue.column_ordinals(rows, ["t"], "column_id", ["c"], span=16)
    want = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("t").orderBy("column_id", "c")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_retention_keeps_newest_runs_and_rows_without_a_config(spark):
    rows = [(1, day, f"f{day}{i}") for day in range(1, 8) for i in range(2)] + [(None, 1, "x"), (2, 3, "y"), (1, None, "z")]
    got = manifest.retain(spark.createDataFrame(rows, "config_id int, run_at int, f string"), 5)
    want = [r for r in rows if r[0] != 1 or r[1] is None or r[1] >= 3]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def depth_parts(spark, rows, kind, partitions, spread=None):
    """The parts that a database would give: its query is run by Spark over a view."""
    rows.createOrReplaceTempView("depth_source")
    source = jdbc.JdbcTable("jdbc:x", "depth_source", partition_column="k", partitions=partitions, spread=spread)
    tiles = spark.sql(f"SELECT * FROM {jdbc.depth_query(source)}").collect()
    ordered = [(t["low"], t["high"], t["n"]) for t in sorted(tiles, key=lambda t: t["tile"])]
    parts = jdbc.depth_predicates(source, ordered)
    return [spark.sql(f"SELECT count(*) AS n FROM depth_source WHERE {p}").first().n for p in parts]


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "timestamp_ntz", "decimal(20,0)"])
def test_jdbc_parts_hold_equally_many_rows(spark, kind):
    """Ids in a dense block, a sparse tail and a far outlier; some have none."""
    number = F.when(F.col("id") < 900, F.col("id")).when(F.col("id") < 990, F.col("id") * 1000).when(F.col("id") < 995, F.col("id") * 3_000)
    value = {"date": F.date_add(F.lit("1990-01-01").cast("date"), (number / 1000).cast("int") + (number % 1000).cast("int")),
             "timestamp_ntz": F.expr("timestamp_ntz '1990-01-01'") + F.make_dt_interval(secs=number)}.get(kind, number.cast(kind))
    rows = spark.range(1000).select(value.alias("k"))
    if kind == "string":
        rows = rows.select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("o'"), "k")).otherwise(F.col("k")).alias("k"))
    sizes = depth_parts(spark, rows, kind, 8)
    assert sum(sizes) == 1000 and len(sizes) >= 7 and max(sizes) <= 2 * 1000 / 8


def test_jdbc_parts_of_a_frequent_value(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 400, F.lit(77)).when(F.col("id") < 420, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("other"))
    sizes = depth_parts(spark, rows, "bigint", 9, "other")
    assert sum(sizes) == 900 and max(sizes) <= 200
    assert sum(depth_parts(spark, rows, "bigint", 9)) == 900
    assert sum(depth_parts(spark, rows.where("k = 77"), "bigint", 4)) == 400
    assert sum(depth_parts(spark, rows.where("id < 3") if "id" in rows.columns else rows.limit(3), "bigint", 4)) in (3, 0)


def test_text_ids_are_compared_as_numbers(spark):
    rows = spark.createDataFrame([("9",), ("10",), ("100",), (None,)], "k string")
    assert sorted(r.k for r in scan.past_cursor(rows, "k", "id", "9").collect()) == ["10", "100"]
    assert [r.k for r in scan.past_cursor(rows, "k", "id", 9, 99).collect()] == ["10"]
    with pytest.raises(Exception):
        scan.past_cursor(spark.createDataFrame([("x1",)], "k string"), "k", "id", 9).collect()
