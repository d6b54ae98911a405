"""Edges and invariants of the delta operators."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import ntz
from tidemark.operators import apply, shape
from tidemark.session import work_path
from tidemark.sinks import storage, tables
from tidemark.sinks.tables import KeyedTable, MissingTableError, replace_table, write_table

def ts():
    return ntz("2024-02-01 00:00:00")


SCHEMA = "k int, v string, w int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def target(spark, rows):
    return shape.with_audit(frame(spark, rows), ntz("2024-01-01 00:00:00"), "b0")


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, x) for x in t))


def test_dedupe_newest_nulls_last_and_ties(spark):
    rows = frame(spark, [(1, "old", 1), (1, "new", 2), (1, "nul", None), (2, "a", 5), (2, "b", 5), (3, "x", None)])
    assert values(apply.dedupe_latest(rows, ["k"], "w"), "k", "v") == [(1, "new"), (2, "b"), (3, "x")]


def test_upsert_twice_is_once(spark):
    t, d = target(spark, [(1, "a", 1), (2, "b", 1)]), frame(spark, [(2, "B", 2), (3, "c", 2)])
    once = apply.upsert(t, d, ["k"], ts(), "b1", "w")
    twice = apply.upsert(once, d, ["k"], ts(), "b1", "w")
    assert values(once, *once.columns) == values(twice, *twice.columns)
    assert values(once, "k", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_upsert_revives_deleted_rows(spark):
    t = target(spark, [(1, "a", 1)]).withColumns({"_is_deleted": F.lit(True), "_deleted_at": ts()})
    got = apply.upsert(t, frame(spark, [(1, "b", 2)]), ["k"], ts(), "b1").first()
    assert (got.v, got._is_deleted, got._deleted_at) == ("b", False, None)


def test_null_keys_never_match(spark):
    t, d = target(spark, [(None, "a", 1), (1, "b", 1)]), frame(spark, [(None, "c", 2), (None, "c", 2), (None, "d", 1)])
    want = [(1, "b"), (None, "a"), (None, "c"), (None, "c"), (None, "d")]
    assert values(apply.upsert(t, d, ["k"], ts(), "b1"), "k", "v") == want
    h = shape.with_history(t, ntz("2024-01-01 00:00:00"))
    assert values(apply.apply_history(h, d, ["k"], ts(), "b1").where("_is_current"), "k", "v") == want


def test_composite_key_with_partial_null(spark):
    t = target(spark, [(1, None, 1), (1, "x", 1)])
    got = apply.upsert(t, frame(spark, [(1, "x", 9), (1, None, 9)]), ["k", "v"], ts(), "b1")
    assert values(got, "k", "v", "w") == [(1, "x", 9), (1, None, 1), (1, None, 9)]


def test_missing_column_becomes_null_or_is_kept(spark):
    t, d = target(spark, [(1, "a", 7)]), frame(spark, [(1, "b")], "k int, v string")
    assert values(apply.upsert(t, d, ["k"], ts(), "b1"), "k", "v", "w") == [(1, "b", None)]
    assert values(apply.upsert(t, d, ["k"], ts(), "b1", keep_missing=True), "k", "v", "w") == [(1, "b", 7)]


def test_empty_sides(spark):
    t, d = target(spark, [(1, "a", 1)]), frame(spark, [(1, "b", 2)])
    assert values(apply.upsert(t, d.limit(0), ["k"], ts(), "b1"), "k", "v") == [(1, "a")]
    assert values(apply.upsert(t.limit(0), d, ["k"], ts(), "b1"), "k", "v") == [(1, "b")]


def test_history_has_one_current_row_per_key(spark):
    h = shape.with_history(target(spark, [(1, "a", 1), (2, "b", 1), (None, "n", 1)]), ntz("2024-01-01 00:00:00"))
    got = apply.apply_history(h, frame(spark, [(1, "A", 2), (1, "AA", 3), (3, "c", 1)]), ["k"], ts(), "b1", "w")
    assert values(got.where("_is_current"), "k", "v") == [(1, "AA"), (2, "b"), (3, "c"), (None, "n")]
    closed = got.where("NOT _is_current").first()
    assert (closed.v, str(closed._valid_to), closed._batch_id) == ("a", "2024-02-01 00:00:00", "b1")


def test_history_only_changed(spark):
    h = shape.with_history(target(spark, [(1, None, 1), (2, "b", 1), (3, "c", 1)]), ntz("2024-01-01 00:00:00"))
    delta = frame(spark, [(1, None, 1), (2, "B", 2), (3, None, 1), (4, "n", 1)])
    got = apply.apply_history(h, delta, ["k"], ts(), "b1", "w", only_changed=True)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
    assert got.where("_is_current").count() == 4


def test_history_needs_a_key(spark):
    with pytest.raises(ValueError):
        apply.apply_history(target(spark, [(1, "a", 1)]), frame(spark, [(1, "a", 1)]), [], ts(), "b1")


def test_reconcile_twice_changes_nothing(spark):
    t, s = target(spark, [(1, "a", 1), (2, "b", 1), (None, "n", 1)]), frame(spark, [(1, "a", 1), (1, "a", 1)])
    once = apply.reconcile(t, s, ["k"], ts())
    twice = apply.reconcile(once, s, ["k"], ntz("2024-03-01 00:00:00"))
    assert values(once, *once.columns) == values(twice, *twice.columns)
    assert values(once.where("_is_deleted"), "k") == [(2,), (None,)]


def test_backlog_equals_batches_in_order(spark):
    t = target(spark, [(1, "a", 1), (2, "b", 1)])
    waiting = frame(spark, [(1, "x", 9, 1), (1, "y", 5, 2), (3, "c", 1, 1), (3, "d", 1, 1), (None, "n", 1, 1), (None, "m", 1, 2)], "k int, v string, w int, n int")
    got = apply.apply_backlog_upsert(t, waiting, ["k"], "n", ts(), "b", "w")
    step = t
    for n in (1, 2):
        step = apply.upsert(step, waiting.where(F.col("n") == n).drop("n"), ["k"], ts(), "b", "w")
    assert values(got, *got.columns) == values(step, *got.columns)


def test_backlog_history_equals_batches_in_order(spark):
    h = shape.with_history(target(spark, [(1, "a", 1), (2, "b", 1)]), ntz("2024-01-01 00:00:00"))
    schema = "k int, v string, w int, n int, at string"
    rows = [(1, "x", 9, 1, "2024-02-01 00:00:00"), (1, "y", 5, 2, "2024-02-02 00:00:00"),
            (3, "c", 1, 2, "2024-02-02 00:00:00"), (1, "z", 1, 3, "2024-02-03 00:00:00"),
            (None, "n", 1, 1, "2024-02-01 00:00:00"), (None, "m", 1, 3, "2024-02-03 00:00:00")]
    waiting = frame(spark, rows, schema).withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = apply.apply_backlog_history(h, waiting, ["k"], "n", "at", "w")
    step = h
    for n in (1, 2, 3):
        batch = waiting.where(F.col("n") == n)
        step = apply.apply_history(step, batch.drop("n", "at"), ["k"], ntz(f"2024-02-0{n} 00:00:00"), str(n), "w")
    assert values(got, *h.columns) == values(step, *h.columns)


def test_hot_key_reaches_the_shuffle_once_per_task(spark):
    rows = spark.range(0, 40_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("k"),
        F.col("id").cast("string").alias("v"), F.col("id").cast("int").alias("w"),
    )
    got = apply.dedupe_latest(rows, ["k"], "w")
    assert "WindowGroupLimit" in plan(got) and plan(got).count("Partial") >= 1
    assert got.count() == rows.select("k").distinct().count()
    assert got.where("k = 0").first().w == 39_999


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anti_join_side_is_reduced_before_the_shuffle(spark, sf_dir):
    target_rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "k")
    other = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "k")
    text = plan(apply.without_keys(target_rows, ["k"], other))
    assert "LeftAnti" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert text.count("HashAggregate") == 2


def test_keyed_table_touches_only_hit_buckets_and_repeats_safely(spark):
    table = KeyedTable(spark, work_path(spark, "kt"), ("k",), 8)
    table.create(target(spark, [(i, "a", 1) for i in range(100)] + [(None, "n", i) for i in range(5)]))
    delta = frame(spark, [(5, "Z", 2), (200, "new", 2), (None, "m", 2)])
    change = lambda t, d, small: apply.upsert(t, d, ["k"], ts(), "b1", "w", small=small)
    assert 1 <= len(table.touched(delta)) <= 3
    table.apply(delta, change, "b1")
    first = values(table.read(), "k", "v", "w")
    assert len(first) == 107 and (5, "Z", 2) in first and (200, "new", 2) in first
    table.apply(delta, change, "b1")
    assert values(table.read(), "k", "v", "w") == first


def test_closed_versions_settle_and_a_repeated_batch_adds_nothing(spark):
    table = KeyedTable(spark, work_path(spark, "hist"), ("k",), 4, "NOT _is_current")
    old = shape.with_history(target(spark, [(1, "a0", 0)]), ntz("2023-01-01 00:00:00")).withColumn("_is_current", F.lit(False))
    start = shape.with_history(target(spark, [(1, "a", 1), (2, "b", 1), (None, "n", 1)]), ntz("2024-01-01 00:00:00"))
    table.create(start.unionByName(old))
    assert table.read_open().count() == 3 and table.read().count() == 4
    want = start.unionByName(old)
    for i in range(2, 5):
        delta = frame(spark, [(1, f"v{i}", i), (i, "x", i)])

        def change(t, d, small):
            return apply.apply_history(t, d, ["k"], ts(), f"b{i}", "w", small=small)

        want = apply.apply_history(want, delta, ["k"], ts(), f"b{i}", "w")
        table.apply(delta, change, f"b{i}")
        table.apply(delta, change, f"b{i}")
        assert values(table.read(), "k", "v", "_is_current", "_batch_id") == values(want, "k", "v", "_is_current", "_batch_id")
    assert table.read_open().where("NOT _is_current").isEmpty()


@pytest.mark.parametrize("limit", [0, 2**25])
def test_small_and_large_deltas_give_the_same_table(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "SMALL_KEY_BYTES", limit)
    table = KeyedTable(spark, work_path(spark, "size"), ("k",), 8)
    start = target(spark, [(i, "a", 1) for i in range(50)] + [(None, "n", i) for i in range(5)])
    table.create(start)
    delta = frame(spark, [(i, "Z", 2) for i in range(40, 60)] + [(None, "m", 9)])
    seen = []

    def change(t, d, small):
        seen.append(small)
        return apply.upsert(t, d, ["k"], ts(), "b1", "w", small=small)

    table.apply(delta, change, "b1")
    assert seen == [limit > 0]
    want = apply.upsert(start, delta, ["k"], ts(), "b1", "w")
    assert values(table.read(), "k", "v", "w") == values(want, "k", "v", "w")


def test_keyed_table_schema_can_grow(spark):
    table = KeyedTable(spark, work_path(spark, "grow"), ("k",), 8)
    table.create(target(spark, [(i, "a", 1) for i in range(20)] + [(None, "n", i) for i in range(9)]))
    delta = frame(spark, [(1, "b", 2, "x")], SCHEMA + ", extra string")
    table.apply(delta, lambda t, d, s: apply.upsert(shape.widen(t, d), d, ["k"], ts(), "b1", "w"), "b1")
    rows = table.read()
    assert rows.count() == 29 and values(rows.where("extra IS NOT NULL"), "k", "extra") == [(1, "x")]


def test_versioned_replace_swaps_at_once(spark):
    base, name = work_path(spark, "swap"), f"swap_{work_path(spark, 'x')[-8:]}"
    replace_table(target(spark, [(1, "a", 1)]), name, base)
    old = spark.table(name)
    replace_table(target(spark, [(2, "b", 1)]), name, base)
    assert values(spark.table(name), "k") == [(2,)] and values(old, "k") in ([(1,)], [(2,)])
    version = replace_table(target(spark, [(3, "c", 1)]), name, base, drop_old=True)
    assert storage.children(spark, base) == [version.rsplit("/", 1)[1]] and values(spark.table(name), "k") == [(3,)]


def test_append_needs_the_table(spark):
    with pytest.raises(MissingTableError):
        write_table(target(spark, [(1, "a", 1)]), "no_such_table_here", "append")


def test_filter_replace_keeps_rows_where_the_predicate_is_null(spark):
    t = target(spark, [(1, None, 1), (2, "x", 1), (3, "y", 1)])
    got = apply.replace_where(t, "v = 'x'", frame(spark, [(9, "new", 1)]), ts(), "b1")
    assert values(got, "k") == [(1,), (3,), (9,)]


def test_merge_statement_names_every_column():
    text = apply.merge_statement("t", "s", ["k"], ["k", "v", "_load_ts"], "b1")
    assert "ON t.`k` = s.`k`" in text and "t.`v` = s.`v`" in text and "_deleted_at = NULL" in text


def test_maps_are_ordered_by_their_entries(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, map('a', 1), 5), (1, map('b', 2), 5), (2, map('c', 3), 1) t(k, m, w)")
    assert sorted(r.k for r in apply.dedupe_latest(rows, ["k"], "w").collect()) == [1, 2]
    nested = rows.select("k", F.array("m").alias("m"), "w")
    assert apply.dedupe_latest(nested, ["k"], "w").count() == 2


def test_a_keyed_table_commits_once(spark):
    """A write that dies leaves the version as it was; a stale writer is told; vacuum removes what is dead."""
    table = KeyedTable(spark, work_path(spark, "commit"), ("k",), 4)
    table.create(target(spark, [(i, "a", 1) for i in range(20)]))
    delta = frame(spark, [(5, "Z", 2)])

    def broken(t, d, small):
        return apply.upsert(t, d, ["k"], ts(), "b1", "w").withColumn("v", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception):
        table.apply(delta, broken, "b1")
    assert table.version().number == 1 and values(table.read(), "v") == [("a",)] * 20
    table._write(table._place(table.read(), 4))
    assert table.read().count() == 20 and table.vacuum() >= 1 and table.read().count() == 20
    old = table.version()
    table.apply(delta, lambda t, d, s: apply.upsert(t, d, ["k"], ts(), "b1", "w"), "b1")
    with pytest.raises(tables.StaleTableError):
        table._commit(replace(old, number=2))
    assert values(table.read().where("v = 'Z'"), "k") == [(5,)]


def test_rows_without_a_key_are_not_rewritten(spark):
    table = KeyedTable(spark, work_path(spark, "no-key"), ("k",), 4)
    table.create(target(spark, [(None, "n", i) for i in range(9)] + [(1, "a", 1)]))
    before = table.version().parts[tables.NO_KEY]
    table.apply(frame(spark, [(None, "m", 1)]), lambda t, d, s: apply.upsert(t, d, ["k"], ts(), "b1", "w"), "b1")
    after = table.version().parts[tables.NO_KEY]
    assert after[: len(before)] == before and len(after) == len(before) + 1
    assert table.read().where("k IS NULL").count() == 10


def test_tables_without_keys_are_written_as_read(spark):
    table = KeyedTable(spark, work_path(spark, "keyless"), (), 4)
    rows = target(spark, [(i, "a", 1) for i in range(5)])
    text = plan(table._place(rows, 4))
    assert "Exchange" not in text
    table.create(rows)
    table.add(rows, "b1")
    table.add(rows, "b1")
    assert table.read().count() == 10


def test_one_scan_serves_rows_with_and_without_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "k")
    assert plan(apply.latest_rows(rows, ["k"], "c_acctbal")).count("FileScan") == 1
    other = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "k")
    assert plan(apply.without_keys(rows, ["k"], other)).count("FileScan") == 2
