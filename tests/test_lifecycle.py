"""Whole runs of one table: full, incremental, skip, drift, reconcile, validate, failure."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import lifecycle
from tidemark.plans.lifecycle import Run, Table
from tidemark.session import work_path
from tidemark.sinks import storage


@pytest.fixture()
def root(spark):
    return work_path(spark, "life")


def run_at(spark, root, day, rows, config="t"):
    source = spark.createDataFrame(rows, "id int, name string, updated_at string").withColumn(
        "updated_at", F.col("updated_at").cast("timestamp_ntz")
    )
    return Run(spark, root, f"b{day}-{uuid.uuid4().hex[:4]}", datetime(2024, 1, day), {config: lambda: source})


def content(spark, root, run, table):
    location = lifecycle.last_state(run, table)[1]
    return lifecycle.stored(run, table, location).read()


FIRST = [(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-01 11:00:00"), (3, "c", "2024-01-01 12:00:00")]
SECOND = [(1, "a2", "2024-01-03 10:00:00"), (2, "b", "2024-01-01 11:00:00"), (4, "d", "2024-01-03 09:00:00")]


def test_full_then_incremental_then_skip(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    first = run_at(spark, root, 2, FIRST)
    assert lifecycle.sync(first, table)["load_type"] == "full"
    second = run_at(spark, root, 4, SECOND)
    record = lifecycle.sync(second, table)
    assert (record["load_type"], record["status"], record["rows_extracted"]) == ("incremental", "success", 2)
    got = {r.id: r.name for r in content(spark, root, second, table).collect()}
    assert got == {1: "a2", 2: "b", 3: "c", 4: "d"}
    third = run_at(spark, root, 5, SECOND)
    assert lifecycle.sync(third, table)["status"] == "skipped"
    assert lifecycle.last_state(third, table)[0] == "2024-01-03 10:00:00"


@pytest.mark.parametrize("after", ["archive", "purge", "keep"])
def test_loaded_extracts_are_put_away(spark, root, after):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    later = replace(run_at(spark, root, 4, SECOND), after_load=after)
    lifecycle.sync(later, table)
    moved = storage.archive_path(root, "incremental", "20240104", f"t/{later.batch_id}")
    left = storage.exists(spark, f"{root}/extracts/t/{later.batch_id}")
    assert (left, storage.exists(spark, moved)) == (after == "keep", after == "archive")
    third = run_at(spark, root, 6, SECOND + [(8, "h", "2024-01-05 00:00:00")])
    lifecycle.sync(third, table)
    assert content(spark, root, third, table).count() == 5


def test_reconcile_and_validate(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    later = run_at(spark, root, 4, SECOND)
    lifecycle.sync(later, table)
    assert lifecycle.validate(later, table)["status"] == "mismatch"
    gone = run_at(spark, root, 5, SECOND)
    assert lifecycle.reconcile(gone, table)["rows_loaded"] == 1
    assert lifecycle.reconcile(run_at(spark, root, 6, SECOND), table)["rows_loaded"] == 0
    assert lifecycle.validate(gone, table, deep=True)["status"] == "success"


def test_reconcile_finds_null_keys_in_every_bucket(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=8)
    nulls = [(None, f"n{i}", "2024-01-01 10:00:00") for i in range(6)]
    first = run_at(spark, root, 2, FIRST + nulls)
    lifecycle.sync(first, table)
    later = run_at(spark, root, 4, FIRST)
    assert lifecycle.reconcile(later, table)["rows_loaded"] == 6
    assert content(spark, root, later, table).where("_is_deleted AND id IS NULL").count() == 6
    assert lifecycle.validate(later, table, deep=True)["status"] == "success"


def test_history_keeps_versions(spark, root):
    table = Table("t", ("id",), scd_type=2, cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    later = run_at(spark, root, 4, SECOND)
    lifecycle.sync(later, table)
    rows = content(spark, root, later, table)
    assert rows.where("id = 1").count() == 2
    assert rows.where("_is_current").groupBy("id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("scd_type", [0, 1])
def test_append_adds_all(spark, root, scd_type):
    table = Table("t", ("id",) if scd_type == 0 else (), scd_type=scd_type, cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    later = run_at(spark, root, 4, SECOND)
    lifecycle.sync(later, table)
    assert content(spark, root, later, table).count() == 5


def test_append_table_reconciles_into_a_new_folder(spark, root):
    table = Table("t", ("id",), scd_type=0, cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    later = run_at(spark, root, 4, SECOND)
    lifecycle.sync(later, table)
    assert lifecycle.reconcile(run_at(spark, root, 5, SECOND), table)["rows_loaded"] == 1
    rows = content(spark, root, later, table)
    assert (rows.count(), rows.where("_is_deleted").count()) == (5, 1)


def test_new_column_is_added_and_old_rows_read_null(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    wide = run_at(spark, root, 4, SECOND)
    source = wide.sources["t"]()
    wide.sources["t"] = lambda: source.withColumn("extra", F.lit("x"))
    assert lifecycle.sync(wide, table)["status"] == "success"
    got = {r.id: r.extra for r in content(spark, root, wide, table).collect()}
    assert got == {1: "x", 2: None, 3: None, 4: "x"}


def test_failure_leaves_the_old_state(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    first = run_at(spark, root, 2, FIRST)
    lifecycle.sync(first, table)
    before = lifecycle.last_state(first, table)
    broken = run_at(spark, root, 4, SECOND)
    broken.sources["t"] = lambda: spark.read.parquet("/no/such/path")
    record = lifecycle.sync(broken, table)
    assert record["status"] == "failed" and "PATH_NOT_FOUND" in record["error_message"]
    assert lifecycle.last_state(broken, table) == before


def test_id_cursor_is_bounded(spark, root):
    table = Table("t", ("id",), cursor_column="id", cursor_type="id", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    later = run_at(spark, root, 4, FIRST + [(9, "z", "2024-01-03 09:00:00")])
    record = lifecycle.sync(later, table)
    assert (record["rows_extracted"], record["watermark_to"]) == (1, "9")
    assert lifecycle.validate(later, table, deep=True)["status"] == "success"


def test_run_all_skips_inactive(spark, root):
    run = run_at(spark, root, 2, FIRST)
    tables = [Table("t", ("id",), cursor_column="updated_at", buckets=2), Table("off", active=False)]
    assert [r["status"] for r in lifecycle.run_all(run, tables)] == ["success"]


def test_command_line(spark, root, sf_dir, tmp_path):
    from tidemark.__main__ import main

    config = tmp_path / "tables.json"
    config.write_text(
        '[{"config_id": "orders", "keys": ["o_orderkey"], "cursor_column": "o_orderdate", "buckets": 4,'
        f' "source": {{"parquet": "{sf_dir}/orders.parquet"}}}},'
        f' {{"config_id": "nation", "load_type": "full", "source": {{"sql": "SELECT * FROM parquet.`{sf_dir}/nation.parquet`"}}}}]'
    )
    assert [r["status"] for r in main(["sync", str(config), "--root", root], spark)] == ["success", "success"]
    checked = main(["validate", str(config), "--root", root, "--deep", "--table", "orders"], spark)
    assert [r["status"] for r in checked] == ["success"]
    again = main(["sync", str(config), "--root", root, "--table", "orders"], spark)
    assert [r["status"] for r in again] == ["skipped"]
    query = f'"source": {{"sql": "SELECT * FROM parquet.`{sf_dir}/orders.parquet` WHERE o_orderkey % 4 <> 2", "where": "o_orderkey % 2 = 0"}}'
    config.write_text(f'[{{"config_id": "orders", "keys": ["o_orderkey"], "load_type": "filter", "cursor_column": "o_orderdate", "buckets": 4, {query}}}]')
    assert [r["status"] for r in main(["sync", str(config), "--root", root], spark)] == ["success"]
    assert [r["status"] for r in main(["vacuum", str(config), "--root", root], spark)] == ["success"]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    setting = Table("orders", ("o_orderkey",))
    run = Run(spark, root, "b", datetime(2024, 1, 1))
    assert content(spark, root, run, setting).count() == orders.where("o_orderkey % 4 <> 2").count()


def test_bucket_count_and_types_come_from_the_table(spark, root):
    """A changed setting and a wider key are followed; another kind of type is refused, and named."""
    lifecycle.sync(run_at(spark, root, 2, FIRST), Table("t", ("id",), cursor_column="updated_at", buckets=4))
    table = Table("t", ("id",), cursor_column="updated_at", buckets=7)
    wide = run_at(spark, root, 4, SECOND)
    source = wide.sources["t"]()
    wide.sources["t"] = lambda: source.withColumn("id", F.col("id").cast("bigint"))
    record = lifecycle.sync(wide, table)
    assert record["status"] == "success" and record["schema_changes"] == "id int -> bigint"
    rows = content(spark, root, wide, table)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4] and dict(rows.dtypes)["id"] == "bigint"
    third = run_at(spark, root, 6, [(9, "z", "2024-01-05 00:00:00")])
    late = third.sources["t"]()
    third.sources["t"] = lambda: late.withColumn("name", F.lit(5))
    record = lifecycle.sync(third, table)
    assert record["status"] == "failed" and "name is string, not int" in record["error_message"]
    assert content(spark, root, third, table).count() == 4


def test_null_cursors_are_counted_in_increments(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    record = lifecycle.sync(run_at(spark, root, 4, SECOND + [(7, "n", None), (8, "m", None)]), table)
    assert (record["rows_extracted"], record["null_cursors"]) == (2, 2)


def test_a_load_that_was_not_logged_is_logged_by_the_next(spark, root):
    table = Table("t", ("id",), scd_type=0, cursor_column="updated_at", buckets=4)
    lifecycle.sync(replace(run_at(spark, root, 2, FIRST), log=False), table)
    later = run_at(spark, root, 4, SECOND)
    lifecycle.sync(later, table)
    log = lifecycle.run_log(later).orderBy("inserted_at").collect()
    assert [(r.load_type, r.rows_loaded) for r in log] == [("full", 3), ("incremental", 2)]
    assert content(spark, root, later, table).count() == 5
    assert lifecycle.sync(run_at(spark, root, 5, SECOND), table)["status"] == "skipped"
    assert lifecycle.run_log(later).where("status = 'success'").count() == 2


def test_appended_tables_take_each_row_once(spark, root):
    """A full load leaves rows past the ceiling to the next increment."""
    table = Table("t", ("id",), scd_type=0, cursor_column="updated_at", buckets=4)
    young = (9, "young", "2024-01-01 23:59:30")
    lifecycle.sync(run_at(spark, root, 2, FIRST + [young]), table)
    later = run_at(spark, root, 4, FIRST + [young])
    lifecycle.sync(later, table)
    assert sorted(r.id for r in content(spark, root, later, table).collect()) == [1, 2, 3, 9]


def test_validate_reports_columns_of_one_side(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    run = run_at(spark, root, 2, FIRST)
    lifecycle.sync(run, table)
    source = run.sources["t"]()
    run.sources["t"] = lambda: source.withColumnRenamed("name", "title")
    record = lifecycle.validate(run, table, deep=True)
    assert record["status"] == "mismatch"
    assert "only in source: title" in record["error_message"] and "only in target: name" in record["error_message"]


def test_known_measures_replace_the_source_scan(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    run = run_at(spark, root, 2, FIRST)
    lifecycle.sync(run, table)
    told = replace(run, measures={"t": lambda: (3, "2024-01-01 12:00:00")})
    assert lifecycle.validate(told, table)["status"] == "success"
    assert lifecycle.validate(replace(run, measures={"t": lambda: (4, "2024-01-01 12:00:00")}), table)["status"] == "mismatch"


def test_backlog_of_a_history_table(spark, root):
    table = Table("t", ("id",), scd_type=2, cursor_column="updated_at", buckets=4)
    lifecycle.sync(run_at(spark, root, 2, FIRST), table)
    for day in (4, 5):
        rows = [(1, f"v{day}", f"2024-01-0{day - 1} 10:00:00"), (day, "x", f"2024-01-0{day - 1} 11:00:00")]
        assert lifecycle.extract(run_at(spark, root, day, rows), table)["status"] == "success"
    last = run_at(spark, root, 6, [])
    assert lifecycle.load_backlog(last, table)["rows_loaded"] == 4
    rows = content(spark, root, last, table)
    assert rows.where("id = 1").count() == 3 and rows.where("id = 1 AND _is_current").first().name == "v5"
    assert lifecycle.load_backlog(last, table)["status"] == "skipped"
    assert lifecycle.files(last).where("status = 'loaded'").count() == lifecycle.files(last).count() > 0
    assert lifecycle.last_state(last, table)[0] == "2024-01-04 11:00:00"


def test_full_loads_keep_two_folders(spark, root):
    table = Table("t", ("id",), load_type="full", buckets=4)
    for day in (2, 3, 4, 5):
        run = run_at(spark, root, day, FIRST[:day - 1])
        lifecycle.sync(run, table)
    folders = [n for n in storage.children(spark, f"{root}/tables/t") if n != "at"]
    assert len(folders) == 2 and content(spark, root, run, table).count() == 3


def test_vacuum_removes_what_no_version_names(spark, root):
    table = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    first = run_at(spark, root, 2, FIRST)
    lifecycle.sync(first, table)
    location = lifecycle.last_state(first, table)[1]
    stored = lifecycle.stored(first, table, location)
    stored._write(stored._place(stored.read(), 4))  # a write that died
    content(spark, root, first, table).write.parquet(f"{root}/tables/t/b0-dead")
    record = lifecycle.vacuum(run_at(spark, root, 3, FIRST), table)
    assert record["status"] == "success" and record["rows_loaded"] >= 2
    assert sorted(storage.children(spark, f"{root}/tables/t")) == sorted(["at", location.rsplit("/", 1)[1]])
    assert content(spark, root, first, table).count() == 3
    assert lifecycle.vacuum(run_at(spark, root, 4, FIRST), Table("other"))["status"] == "skipped"


def test_a_filter_load_leaves_the_cursor_and_first_ones_have_none(spark, root):
    incremental = Table("t", ("id",), cursor_column="updated_at", buckets=4)
    by_filter = replace(incremental, load_type="filter", filter="id % 2 = 0")
    lifecycle.sync(run_at(spark, root, 2, FIRST), incremental)
    later = run_at(spark, root, 4, SECOND)
    assert lifecycle.sync(later, by_filter)["watermark_to"] == "2024-01-01 12:00:00"
    assert lifecycle.sync(run_at(spark, root, 5, SECOND), incremental)["rows_extracted"] == 2
    new = f"{root}-new"
    assert lifecycle.sync(run_at(spark, new, 2, FIRST), by_filter)["status"] == "success"
    record = lifecycle.sync(run_at(spark, new, 4, SECOND), incremental)
    assert (record["load_type"], record["rows_loaded"]) == ("full", 3)


def test_gaps_are_probed_and_given_up(spark, root):
    table = Table("t", ("id",), cursor_column="id", cursor_type="id", scd_type=0, gap_minutes=2 * 24 * 60, buckets=4)
    at = "2024-01-01 00:00:00"
    early = (1, 2, 3, 4, 5, 7, 9)
    for day, ids in ((2, (1, 2, 5)), (3, (1, 2, 3, 5, 9)), (4, early), (7, (*early, 10)), (8, (*early, 6, 8, 10, 11))):
        run = run_at(spark, root, day, [(i, "x", at) for i in ids])
        assert lifecycle.sync(run, table)["status"] == "success"
    # 6 and 8 came after they were given up
    assert sorted(r.id for r in content(spark, root, run, table).collect()) == [1, 2, 3, 4, 5, 7, 9, 10, 11]
    assert lifecycle.last_state(run, table)[0] == "11"
