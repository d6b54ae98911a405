"""Ids missing below a cursor; digests of keys; where two sides differ."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import ntz
from tidemark.operators import locate, parity, shape
from tidemark.plans import gaps
from tidemark.session import work_path
from tidemark.sinks.tables import NO_KEY, KeyedTable

NOW = datetime(2024, 1, 31)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def spans_of(df):
    return sorted((r.low, r.high) for r in df.collect())


def expanded(df):
    return sorted(i for low, high in spans_of(df) for i in range(low, high + 1))


@pytest.mark.parametrize("bits", [2, 16])
def test_missing_ids_are_the_window_without_those_seen(spark, monkeypatch, bits):
    monkeypatch.setattr(gaps, "BLOCK_BITS", bits)
    r = random.Random(bits)
    seen = {r.randrange(-40, 151) for _ in range(120)}
    left = gaps.ledger(ids(spark, [*seen, *seen, None, 5000]), None, -30, 150, NOW, 60)
    assert expanded(left) == sorted(set(range(-29, 151)) - seen)
    later = set(r.sample(sorted(set(range(-29, 151)) - seen), 20)) | set(range(151, 180, 3))
    again = gaps.ledger(ids(spark, later), left, 150, 180, NOW + timedelta(minutes=30), 60)
    assert expanded(again) == sorted(set(range(-29, 181)) - seen - later)
    # spans of the first run are too old now
    assert expanded(gaps.ledger(ids(spark, []), again, 180, 180, NOW + timedelta(minutes=80), 60)) == [i for i in range(151, 181) if i not in later]


@pytest.mark.parametrize("pushed", [0, 200])
def test_late_rows_are_those_in_spans(spark, monkeypatch, pushed):
    monkeypatch.setattr(gaps, "PUSHED", pushed)
    spans = spark.createDataFrame([(3, 5, NOW), (9, 9, NOW), (65_530, 65_540, NOW)], gaps.SPANS)
    source = spark.range(0, 70_000).withColumnRenamed("id", "n")
    got = gaps.late_rows(source, F.col("n"), spans, 70_000)
    assert sorted(r.n for r in got.collect()) == [3, 4, 5, 9, *range(65_530, 65_541)] and got.columns == ["n"]
    assert gaps.late_rows(source, F.col("n"), spans.limit(0), 10).count() == 0


def test_locate_finds_changed_missing_extra_and_repeated_keys(spark):
    r = random.Random(3)
    rows = [(i if r.random() > 0.02 else None, f"g{i % 2}", r.random(), f"t{i}" if i % 5 else None) for i in range(3000)]
    schema = "k long, g string, x double, t string"
    other, want = [], {}
    for row in rows:
        act = r.random()
        if row[0] is None or act > 0.02:
            other.append(row)
        elif act < 0.005:
            want[row[:2]] = "missing"
        elif act < 0.01:
            other.append((*row[:2], row[2] + 1e-12, row[3]))
            want[row[:2]] = "changed"
        elif act < 0.015:
            other += [row, row]
            want[row[:2]] = "changed"
        else:
            other += [row, (row[0] + 100_000, *row[1:])]
            want[(row[0] + 100_000, row[1])] = "extra"
    a, b = (spark.createDataFrame(x, schema) for x in (rows, other))
    got = {(x.k, x.g): x.kind for x in locate.locate(a, b, ["k", "g"]).collect()}
    assert got == want and set(want.values()) == {"missing", "changed", "extra"}
    assert locate.locate(a, a, ["k", "g"]).isEmpty() and locate.locate(a.limit(0), b.limit(0), ["k", "g"]).isEmpty()
    kinds = {x.kind for x in locate.locate(a.limit(0), b, ["k"]).collect()}
    assert kinds == {"extra"}


def test_equal_leaves_are_not_read_again(spark):
    a = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 5, 2).otherwise(1))
    trees = locate.leaves(a, ["k"], ["k", "v"]), locate.leaves(b, ["k"], ["k", "v"])
    assert locate.differing_leaves(*trees).count() == 1
    assert [tuple(r) for r in locate.locate(a, b, ["k"], trees=trees).collect()] == [(5, "changed", 1, 1)]


def test_digests_name_the_buckets_whose_keys_differ(spark):
    table = KeyedTable(spark, work_path(spark, "digest"), ("k",), 8)
    rows = spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"))
    table.create(shape.with_audit(rows, ntz("2024-01-31"), "b0"))
    assert table.differing(rows.withColumn("k", F.col("k").cast("bigint")))[0] == []
    gone = rows.where("k IN (3, 77)")
    buckets, keys = table.differing(rows.where("k NOT IN (3, 77)"))
    assert sorted(buckets) == sorted(table.touched(gone)) and keys.count() == table.read_buckets(buckets).count() - 2
    assert table.differing(rows.limit(0))[0] == sorted(table.touched(rows))
    empty = KeyedTable(spark, work_path(spark, "digest"), ("k",), 8)
    empty.create(shape.with_audit(rows.limit(0), ntz("2024-01-31"), "b0"))
    assert empty.differing(rows.limit(0))[0] == [] and len(empty.differing(rows)[0]) == 8
    loose = KeyedTable(spark, work_path(spark, "digest"), ("k",), 8)
    loose.create(shape.with_audit(rows.limit(3).unionByName(rows.limit(1).withColumn("k", F.lit(None).cast("int"))), ntz("2024-01-31"), "b0"))
    assert loose.differing(rows.limit(3))[0] == [NO_KEY]


def test_sketches_rule_out_and_the_exact_check_decides(spark):
    rows = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 100).alias("b"), (F.col("id") / 2).cast("long").alias("c"), F.when(F.col("id") != 7, F.col("id")).alias("n"))
    near = rows.withColumn("a", F.when(F.col("a") == 1, 0).otherwise(F.col("a")))  # one pair
    candidates = [["b"], ["c"], ["n"], ["a"], ["a", "b"]]
    told = {r["keys"]: r.plausible for r in parity.sketched_keys(near, candidates).collect()}
    assert told == {"b": False, "c": False, "n": False, "a": True, "a, b": True}
    keys, check = parity.propose_key(near, candidates)
    assert keys == ["a", "b"] and check.first().is_unique
    assert parity.propose_key(rows, candidates)[0] == ["a"] and parity.propose_key(rows, [["b"], ["n"]]) is None


@pytest.mark.parametrize("bits", [3, 16])
def test_ids_and_spans_of_a_block_are_met_in_one_pass(spark, monkeypatch, bits):
    monkeypatch.setattr(gaps, "BLOCK_BITS", bits)
    monkeypatch.setattr(gaps, "PUSHED", 0)
    spans = spark.createDataFrame([(i, i + (i % 7 == 0), NOW) for i in range(-300, 3000, 3)], gaps.SPANS)
    source = spark.createDataFrame([(i, f"t{i}") for i in [*range(-310, 3010), 6, 6]] + [(None, "none")], "n long, `a t` string")
    got = gaps.late_rows(source, F.col("n"), spans, 2500)
    held = {x for i in range(-300, 3000, 3) for x in range(i, i + 1 + (i % 7 == 0))}
    assert sorted(map(tuple, got.collect())) == sorted((i, f"t{i}") for i in [*range(-310, 2501), 6, 6] if i in held)
    # a join by block compares each id with all spans of its block
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and got.columns == source.columns
