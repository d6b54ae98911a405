"""Files of keyed tables: which a delta rewrites, how they are merged, how versions and logs name them."""

from __future__ import annotations

import json
import os
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session
from tidemark.functions.values import ntz
from tidemark.operators import apply, shape
from tidemark.session import work_path
from tidemark.sinks import files as out
from tidemark.sinks import keyindex, logfolder, storage, tables, versions
from tidemark.sinks.logfolder import LogFolder
from tidemark.sinks.tables import NO_KEY, SETTLED, KeyedTable
from tidemark.sinks.versions import Version, VersionLog

TS = "2024-01-31 00:00:00"


def upserting(keys, batch="b1"):
    return lambda t, d, small: apply.upsert(t, d, keys, ntz(TS), batch, small=small)


def rows_of(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


def made(spark, rows, keys, **options):
    table = KeyedTable(spark, work_path(spark, "files"), keys, options.pop("buckets", 2), prune_from=0, **{"file_bytes": 1, **options})
    table.create(shape.with_audit(rows, ntz(TS), "b0"))
    return table


def holding(table, delta, keys):
    version = table.version()
    stored = table._rows(version.schema, version.files, named=True)
    return {tuple(r) for r in stored.join(delta.select(*keys), list(keys), "left_semi").select("_bucket", "_file").distinct().collect()}


@pytest.mark.parametrize("kind", ["long", "string", "date", "timestamp_ntz", "decimal(20,2)"])
def test_a_sparse_delta_rewrites_files_that_hold_its_keys(spark, kind):
    number = F.col("id")
    key = {"date": F.date_add(F.lit("2000-01-01").cast("date"), number.cast("int")), "timestamp_ntz": F.expr("timestamp_ntz '2000-01-01' + make_interval(0, 0, 0, 0, 0, id)")}
    start = spark.range(4000).select(key.get(kind, number.cast(kind)).alias("k"), F.lit("a").alias("v"))
    table = made(spark, start, ("k",), file_rows=100)
    hit = start.where(F.xxhash64("k") % 700 == 0)
    n, held, files = hit.count(), holding(table, hit, ["k"]), sum(map(len, table.version().files.values()))
    did = table.apply(hit.withColumn("v", F.lit("Z")), upserting(["k"]), "b1")
    assert 0 < len(held) <= did.rewritten <= 1.1 * len(held) + 1 and len(held) < did.rewritten + did.left <= files
    got = {r.v: r.n for r in table.read().groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == {"Z": n, "a": 4000 - n} and table.read().select("k").distinct().count() == 4000


def test_deltas_one_after_another_give_what_plain_upserts_give(spark):
    r = random.Random(4)
    rows = {(i, f"g{i % 3}"): f"a{i}" for i in range(600)}
    schema = "k long, g string, v string"
    table = made(spark, rows_of(spark, [(*k, v) for k, v in rows.items()], schema), ("k", "g"), file_rows=20, buckets=3)
    for n in range(6):
        change = {(r.randrange(700), f"g{r.randrange(3)}"): f"b{n}" for _ in range(5)}
        rows.update(change)
        table.apply(rows_of(spark, [(*k, v) for k, v in change.items()], schema), upserting(["k", "g"]), f"b{n}")
        table.apply(rows_of(spark, [(*k, "again") for k in change], schema), upserting(["k", "g"]), f"b{n}")
    assert sorted(tuple(x) for x in table.read().select("k", "g", "v").collect()) == sorted((*k, v) for k, v in rows.items())


def test_new_keys_alone_rewrite_nothing(spark):
    table = made(spark, spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=50)
    did = table.apply(rows_of(spark, [(10_000, "new"), (None, "none")]), upserting(["k"]), "b1")
    assert did.rewritten == 0 and table.read().count() == 2002


def test_history_closes_versions_in_the_files_that_hold_them(spark):
    start = shape.with_history(shape.with_audit(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), ntz(TS), "b0"), ntz(TS))
    table = KeyedTable(spark, work_path(spark, "files"), ("k",), 2, "NOT _is_current", file_rows=40, file_bytes=1, prune_from=0)
    table.create(start)
    delta = rows_of(spark, [(5, "b"), (700, "b"), (2000, "b")])
    did = table.apply(delta, lambda t, d, small: apply.apply_history(t, d, ["k"], ntz(TS), "b1", small=small), "b1")
    rows = table.read()
    assert 1 <= did.rewritten <= 3 and rows.count() == 1003 and rows.where("NOT _is_current").count() == 2
    assert set(table.version().files[SETTLED]) and rows.where("_is_current").groupBy("k").count().where("count > 1").isEmpty()


def test_a_wider_key_is_found_by_the_index(spark):
    table = made(spark, spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=40)
    table.apply(rows_of(spark, [(7, "b")]), upserting(["k"]), "b1")
    table.apply(rows_of(spark, [(8, "c"), (7, "c")]), upserting(["k"]), "b2")
    assert table.read().where("v <> 'a'").count() == 2 and table.read().count() == 1000


def test_index_folders_and_small_files_are_merged(spark):
    table = made(spark, spark.range(400).select(F.col("id").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=100, file_bytes=1 << 28)
    for i in range(18):
        table.apply(rows_of(spark, [(i * 20, f"b{i}")]), upserting(["k"]), f"b{i}")
    assert len(storage.children(spark, f"{table.path}/index")) <= 17
    assert all(len(f) <= 12 for b, f in table.version().files.items() if b >= 0)
    assert table.read().where("v <> 'a'").count() == 18 and table.read().count() == 400


def test_appended_runs_are_merged_by_size(spark):
    rows = spark.range(30).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    table = KeyedTable(spark, work_path(spark, "runs"), (), fan=3)
    table.create(rows.where("k = 0").coalesce(1))
    for i in range(1, 14):
        before = table.read()
        table.add(rows.where(F.col("k") == i).coalesce(1), f"b{i}")
        assert before.count() == i  # files of the version before are still there
    version = table.version()
    assert len(version.folders) < 3 and table.read().count() == 14 == table.read().select("k").distinct().count()
    assert table.vacuum() >= 0 and table.read().count() == 14
    left = {p.split("_write=")[1] for p in storage.matching(spark, f"{table.data}/_bucket=*/_write=*")}
    assert left == {w for _, w in version.folders}


def test_rows_without_a_key_are_merged_too(spark):
    table = KeyedTable(spark, work_path(spark, "runs"), ("k",), 2, fan=3)
    table.create(shape.with_audit(rows_of(spark, [(1, "a")]), ntz(TS), "b0"))
    for i in range(7):
        table.apply(rows_of(spark, [(None, f"n{i}")]).coalesce(1), upserting(["k"]), f"b{i}")
    assert len(table.version().files[NO_KEY]) < 4 and table.read().where("k IS NULL").count() == 7


def test_versions_name_changes_since_a_base(spark, monkeypatch):
    monkeypatch.setattr(versions, "LEAST_TAIL", 6)
    log = VersionLog(spark, work_path(spark, "versions"))
    schema = T.StructType.fromDDL("k long")
    now, want, bases = Version(0, schema, ("k",), 4, {}), {}, set()
    r = random.Random(1)
    for n in range(25):
        add = {r.randrange(3): {f"w{n}/f{i}": i for i in range(r.randint(1, 2))}}
        drop = {}
        if n % 3 == 2:
            bucket = r.choice([b for b in want if want[b]])
            drop = {bucket: [r.choice(sorted(want[bucket]))]}
        for b, names in drop.items():
            for x in names:
                del want[b][x]
        for b, names in add.items():
            want.setdefault(b, {}).update(names)
        now = now.after(add, drop)
        log.publish(now)
        log.forget(now.number - 1)
        now = log.newest()
        bases.add(now.base)
        assert now.files == {b: f for b, f in want.items() if f} and now.number == n + 1
        assert sum(len(x) for a, d in now.tail for x in (*a.values(), *d.values())) <= max(6, sum(map(len, now.files.values())) // 4)
    kept = [n for n in storage.children(spark, f"{log.path}/versions")]
    assert 1 < len(bases) < 25 and len(kept) <= versions.KEPT_VERSIONS + 1
    assert len(storage.children(spark, f"{log.path}/bases")) <= len(kept) + 1
    with pytest.raises(versions.StaleTableError):
        log.publish(replace(now, note={"other": 1}))


def test_a_log_of_many_writes_has_few_folders(spark, monkeypatch):
    monkeypatch.setattr(logfolder, "FAN", 3)
    log = LogFolder(spark, work_path(spark, "log"), T.StructType.fromDDL("n long"))
    assert log.read() is None
    for n in range(11):
        log.append(spark.range(n, n + 1).toDF("n"))
        assert sorted(r.n for r in log.read().collect()) == list(range(n + 1))
    assert len(log.folders()) <= 5
    # a write that is under way is not taken by a merge, nor read
    unfinished = f"{log.path}/write=0123"
    spark.range(99, 100).toDF("n").write.parquet(unfinished)
    storage.purge(spark, f"{unfinished}/_SUCCESS")
    assert log.read().where("n = 99").isEmpty()


def test_two_merges_of_a_log_at_once_give_its_rows_once(spark, monkeypatch):
    log = LogFolder(spark, work_path(spark, "log"), T.StructType.fromDDL("n long"))
    for n in range(6):
        log.append(spark.range(n, n + 1).toDF("n"))
    monkeypatch.setattr(logfolder, "FAN", 6)
    publish, done = storage.publish_text, []

    def late(session, path, text):
        if not done:  # another run merges the same folders first
            done.append(1)
            assert LogFolder(spark, log.path, log.schema).merge() == 6
        return publish(session, path, text)

    monkeypatch.setattr(storage, "publish_text", late)
    assert log.merge() == 0
    assert sorted(r.n for r in log.read().collect()) == list(range(6)) and len(log.folders()) == 1


@pytest.mark.parametrize("gzip", [False, True])
def test_parts_are_cut_by_bytes_at_line_ends(spark, gzip):
    r = random.Random(2)
    lines = ["x" * r.choice([0, 1, 5, 40, 900, 5000]) + ("ä" if r.random() < 0.3 else "") for _ in range(400)]
    path = work_path(spark, "rolled")
    out.write_rolling(spark.createDataFrame([(x,) for x in lines], "value string").repartition(3), path, 2000, "head", gzip)
    parts = {p.name: p for p in out.read_manifest(spark, path).collect()}
    place = path.removeprefix("file:")
    names = {n for n in os.listdir(place) if not n.startswith((".", "_"))}
    assert names == set(parts) and not [n for n in os.listdir(place) if n.startswith("_writing")]
    import gzip as packed

    got = []
    for n in names:
        raw = (packed.open if gzip else open)(f"{place}/{n}", "rb").read()
        body = raw.decode().split("\n")
        assert len(raw) == parts[n].bytes and body[0] == "head" and body[-1] == "" and len(body) - 2 == parts[n].rows
        assert len(raw) <= 2000 or parts[n].rows == 1
        got += body[1:-1]
    assert sorted(got) == sorted(lines)
    assert json.load(open(f"{place}/{out.MANIFEST}"))


def test_an_empty_sink_and_wide_rows(spark):
    path = work_path(spark, "rolled")
    out.write_rolling(spark.createDataFrame([], "value string"), path, 100)
    assert out.read_manifest(spark, path).count() == 0
    rows = spark.createDataFrame([(i, "w" * (10 if i % 50 else 30_000)) for i in range(500)], "id long, t string").repartition(2)
    path = work_path(spark, "rolled")
    out.write_sized_parts(rows, path, 20_000)
    sizes = [p.bytes for p in out.read_manifest(spark, path).where("rows > 1").collect()]
    assert sizes and max(sizes) <= 20_000


def test_a_task_that_fails_leaves_no_part(spark):
    path = work_path(spark, "rolled")
    bad = spark.range(100).select(F.when(F.col("id") == 70, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception):
        out.write_rolling(bad.repartition(4), path, 50)
    assert [n for n in storage.children(spark, path) if not n.startswith("_")] == []


def test_a_merge_that_dies_changes_nothing(spark, monkeypatch):
    rows = spark.range(30).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    table = KeyedTable(spark, work_path(spark, "runs"), (), fan=3)
    table.create(rows.where("k = 0").coalesce(1))
    table.add(rows.where("k = 1").coalesce(1), "b1")
    publish = VersionLog.publish

    def dies(self, new):
        if new.number == 4:  # the third run is version 3, and their merge would be 4
            raise OSError("lost")
        publish(self, new)

    monkeypatch.setattr(VersionLog, "publish", dies)
    with pytest.raises(OSError):
        table.add(rows.where("k = 2").coalesce(1), "b2")
    assert table.read().count() == 3 and table.committed("", "b2")
    monkeypatch.setattr(VersionLog, "publish", publish)
    table.add(rows.where("k = 2").coalesce(1), "b2")  # the same batch again adds nothing
    table.add(rows.where("k = 3").coalesce(1), "b3")
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 3] and len(table.version().folders) < 3


def test_an_index_that_was_lost_is_made_again(spark):
    table = made(spark, spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=40)
    table.apply(rows_of(spark, [(7, "b")]), upserting(["k"]), "b1")
    storage.purge(spark, table.index.path)
    did = table.apply(rows_of(spark, [(7, "c"), (500, "c")]), upserting(["k"]), "b2")
    assert 1 <= did.rewritten <= 3 and sorted(r.k for r in table.read().where("v = 'c'").collect()) == [7, 500] and table.read().count() == 1000


def test_dense_deltas_and_small_tables_skip_the_index(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    dense = made(spark, rows, ("k",), file_rows=100)
    dense.apply(rows.withColumn("v", F.lit("b")), upserting(["k"]), "b1")
    small = KeyedTable(spark, work_path(spark, "files"), ("k",), 2, file_rows=100)
    small.create(shape.with_audit(rows, ntz(TS), "b0"))
    small.apply(rows_of(spark, [(7, "b")]), upserting(["k"]), "b1")
    assert not storage.exists(spark, dense.index.path) and not storage.exists(spark, small.index.path)
    assert dense.read().where("v = 'b'").count() == 1000 and small.read().where("v = 'b'").count() == 1


def test_folders_of_many_files_are_read_whole_but_for_what_was_dropped(spark, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 3)
    monkeypatch.setattr(storage, "ONE_BY_ONE", 5)
    table = made(spark, spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=20)
    assert len(table._paths(table.version().files)[0]) == 2  # one for each bucket, not one for each file
    did = table.apply(rows_of(spark, [(7, "b"), (500, "b"), (-1, "b")]), upserting(["k"]), "b1")
    paths, others = table._paths(table.version().files)
    assert len(paths) < 10 and len(others) == did.rewritten > 0
    rows = table.read()
    for name in others:  # as the next change does: readers have not opened them
        assert storage.purge(spark, f"{table.data}/{name}")
    assert sorted((r.k, r.v) for r in rows.collect()) == [(-1, "b"), *((k, "b" if k in (7, 500) else "a") for k in range(1000))]


def test_keys_meet_the_ranges_they_lie_in(spark):
    r = random.Random(5)
    ends = [tuple(sorted((r.randrange(-900, 900), r.randrange(-900, 900)))) for _ in range(40)] + [(-(1 << 62), 1 << 62), (None, None)]
    tops = rows_of(spark, [(i % 2, f"f{i}", a, b, 1) for i, (a, b) in enumerate(ends)], "_bucket int, _file string, low long, high long, pages long")
    keys = [(i % 2, i, r.randrange(-1000, 1000) if i % 9 else None) for i in range(90)]
    got = keyindex._inside(rows_of(spark, keys, "_bucket int, h long, o long"), tops)
    want = [(h, f"f{i}") for b, h, o in keys for i, (low, high) in enumerate(ends) if b == i % 2 and (o is None or low is None or low <= o <= high)]
    assert sorted((x.h, x._file) for x in got.collect()) == sorted(want)


def test_only_files_with_a_key_in_their_range_get_a_filter(spark):
    table = made(spark, spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=20)
    for n, k in enumerate((7, 500, 500)):
        table.apply(rows_of(spark, [(k, f"b{n}"), (-k - n, f"b{n}")]), upserting(["k"]), f"b{n}")
    files = table.index.entries().groupBy("_bucket", "_file").agg(F.count("bits").alias("n"))
    assert files.count() >= 50 and 1 <= files.where("n > 0").count() <= 12
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 1003 and (rows[7], rows[500], rows[-7], rows[-501], rows[-502]) == ("b0", "b2", "b0", "b1", "b2")


def test_files_of_a_task_have_key_ranges_of_their_own(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 387, F.lit(1000)).alias("k"), F.lit("a").alias("v"))
    table = made(spark, rows.coalesce(1), ("k",), file_rows=20)
    table.apply(rows_of(spark, [(k, "b") for k in range(5, 1000, 100)]), upserting(["k"]), "b1")
    stored = table._rows(table.version().schema, table.version().files, named=True)
    task = F.regexp_extract("_file", "part-[0-9]+-[0-9a-f-]+", 0)
    ends = stored.groupBy("_bucket", task.alias("t"), "_file").agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()
    for a in ends:
        assert not [b for b in ends if (a._bucket, a.t) == (b._bucket, b.t) and a.low < b.low <= a.high]
    assert len(ends) >= 50 and table.read().where("v = 'b'").count() == 10 and table.read().count() == 1000


def test_many_limited_files_are_written_by_several_tasks(spark):
    rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("v"))
    table = made(spark, rows, ("k",), file_rows=40)
    names = [n for files in table.version().files.values() for n in files]
    assert len({re.search("part-([0-9]+)", n)[1] for n in names}) >= 6 and table.read().count() == 60_000


def test_folders_a_writer_has_seen_are_not_listed_again(spark, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 3)
    table = made(spark, spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), ("k",), file_rows=20)
    with monkeypatch.context() as m:
        m.setattr(storage, "count", lambda spark, folder: pytest.fail("listed"))
        for n, k in enumerate((7, 500)):
            table.apply(rows_of(spark, [(k, f"b{n}")]), upserting(["k"]), f"b{n}")
        mine = table._paths(table.version().files)
        assert table.read().where("v <> 'a'").count() == 2 and table.read().count() == 1000
    tables._seen.clear()  # as in another process
    assert tuple(map(sorted, table._paths(table.version().files))) == tuple(map(sorted, mine)) and table.read().count() == 1000


def test_a_write_that_dies_leaves_no_files(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    table = made(spark, rows, ("k",))
    lost = rows.withColumn("v", F.when(F.col("k") == 70, F.raise_error(F.lit("lost")).cast("string")).otherwise("b"))
    with pytest.raises(Exception):
        table.add(lost.repartition(4), "b1")
    assert table.vacuum() == 0 and table.read().where("v = 'a'").count() == 100


def test_partitions_of_a_large_delta_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_ROWS", 10)
    names, seen, write = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"), [], KeyedTable._write

    def spied(self, rows):
        seen.append((int(spark.conf.get(names[0])), session._size(spark.conf.get(names[1]))))
        return write(self, rows)

    before = [spark.conf.get(n) for n in names]
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    table = made(spark, rows, ("k",), small_bytes=0)
    monkeypatch.setattr(KeyedTable, "_write", spied)
    table.apply(rows.withColumn("v", F.lit("b")), upserting(["k"]), "b1")
    assert seen[0][0] == 100 and seen[0][1] <= 64 << 20  # 500 rows of the table, 500 of the delta
    assert [spark.conf.get(n) for n in names] == before and table.read().where("v = 'b'").count() == 500
    lost = rows.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        table.apply(lost, upserting(["k"]), "b2")
    assert [spark.conf.get(n) for n in names] == before
    with session.bounded_partitions(spark, 900, 1.0), session.bounded_partitions(spark, 50, 100.0):
        assert spark.conf.get(names[0]) == "90" and session._size(spark.conf.get(names[1])) == 1 << 20
    assert [spark.conf.get(n) for n in names] == before and [session._size(x) for x in ("67108864b", "64MB", "1g", "5")] == [1 << 26, 1 << 26, 1 << 30, 5]


def test_a_history_of_changed_values_is_shuffled_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_ROWS", 10)
    rows, seen = spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("v")), []
    table = KeyedTable(spark, work_path(spark, "files"), ("k",), 2, settled="NOT _is_current", small_bytes=0)
    table.create(shape.with_history(shape.with_audit(rows, ntz(TS), "b0"), ntz(TS)))
    write = KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, r: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), write(self, r))[1])
    touched = rows.withColumn("v", F.when(F.col("k") % 2 == 0, 2).otherwise(1))
    table.apply(touched, lambda t, d, small: apply.apply_history(t, d, ["k"], ntz(TS), "b1", only_changed=True, small=small), "b1")
    assert seen[0] == 60 and table.read().count() == 450 and table.read().where("NOT _is_current AND v = 1").count() == 150


@pytest.mark.parametrize("small_bytes", [0, None])
def test_rows_of_a_table_are_not_broadcast_for_packing_well(spark, monkeypatch, small_bytes):
    names, plans, write = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), [], KeyedTable._write
    before = [spark.conf.get(n) for n in names]

    def spied(self, rows):
        assert spark.conf.get(names[1]) == before[0]  # what AQE has seen may still be broadcast
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows)

    rows = spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    table = KeyedTable(spark, work_path(spark, "files"), ("k",), 2, settled="NOT _is_current", small_bytes=small_bytes)
    table.create(shape.with_history(shape.with_audit(rows, ntz(TS), "b0"), ntz(TS)))
    monkeypatch.setattr(KeyedTable, "_write", spied)
    changing = lambda t, d, small: apply.apply_history(t, d, ["k"], ntz(TS), "b1", only_changed=True, small=small)
    table.apply(rows.withColumn("v", F.when(F.col("k") % 2 == 0, 2).otherwise(1)), changing, "b1")
    joins = [line for line in plans[0].splitlines() if "Join" in line]
    assert joins and not [j for j in joins if "BroadcastHashJoin" in j and (small_bytes == 0 or "LeftAnti" in j)]
    assert table.read().count() == 450 and table.read().where("NOT _is_current AND v = 1").count() == 150
    monkeypatch.setattr(KeyedTable, "_write", lambda self, r: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.apply(rows, changing, "b2")
    assert [spark.conf.get(n) for n in names] == before


def test_broadcasts_are_measured_until_all_are_done(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "5000")  # a session's own limit stays
    with session.measured_broadcasts(spark), session.bounded_partitions(spark, 10, 1.0):
        with session.measured_broadcasts(spark):
            pass
        assert [spark.conf.get(n) for n in names] == ["-1", "5000"]
    assert [spark.conf.get(n) for n in names] == [before[0], "5000"]
    spark.conf.unset(names[1])
    with session.measured_broadcasts(spark):
        assert [spark.conf.get(n) for n in names] == ["-1", before[0]]
    assert [spark.conf.get(n) for n in names] == before
