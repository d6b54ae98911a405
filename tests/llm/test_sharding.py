import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.sharding import OVERHEAD, shard_documents, shard_rows


def laws(rows, got, shards):
    """Each row once, sizes and checksums right, slots gapless, bytes near equal."""
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, len((t or "").encode()) + OVERHEAD, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((x.doc_id is None, x.doc_id or 0, x["size"], x.text_crc32) for x in got) == want
    held = {s: [] for s in range(shards)}
    for x in got:
        held[x.shard].append(x)
    for xs in held.values():
        assert sorted(x.slot for x in xs) == list(range(len(xs)))
    return {s: sum(x["size"] for x in xs) for s, xs in held.items()}


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_near_equal_bytes_and_whole_groups(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(400) + str(i)) for i in range(6000)]
    rows += [(10_000 + i, "the same " * 20) for i in range(10)]
    got = shard_rows(frame(spark, rows), 8).collect()
    sizes = laws(rows, got, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * mean
    assert len({x.shard for x in got if x.doc_id >= 10_000}) == 1
    again = shard_rows(frame(spark, rows).repartition(7), 8).collect()
    assert {x.doc_id: (x.shard, x.slot) for x in got} == {x.doc_id: (x.shard, x.slot) for x in again}


def test_hot_group_is_split(spark):
    r = random.Random(2)
    rows = [(i, "hot text " * 10) for i in range(2000)] + [(5000 + i, "y" * r.randrange(200) + str(i)) for i in range(3000)]
    sizes = laws(rows, shard_rows(frame(spark, rows), 10).collect(), 10)
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 10


def test_overfull_ranges_are_split_again(spark, monkeypatch):
    """Rows alike in text and id share one key; small limits make every deal happen."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 2)
    rows = [(None, "all alike")] * 900 + [(i, f"text {i % 400}") for i in range(1500)]
    sizes = laws(rows, shard_rows(frame(spark, rows), 5).collect(), 5)
    assert max(sizes.values()) < 1.06 * sum(sizes.values()) / 5


def test_ranges_are_split_until_none_is_overfull(spark, monkeypatch):
    """With few parts a split, one level would leave ranges of hundreds of rows; a hot key is a part by itself."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 60)
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 1)
    monkeypatch.setattr(sharding, "PARTS", 6)
    rows = [(None, "all alike")] * 300 + [(i, "same text") for i in range(200)] + [(i, f"text {i % 700}") for i in range(900)]
    df = frame(spark, rows)
    keyed = df.select(sharding.size_of(df.text).alias("size"), sharding.order_key(df.text, df.doc_id).alias("key")).withColumn("range", F.lit(0))
    units = sharding._in_units(keyed, *sharding._splits(keyed)).groupBy("range", "part", "piece").count().collect()
    assert sum(u["count"] for u in units) == 1400 and max(u["count"] for u in units) <= 61
    sizes = laws(rows, shard_rows(df, 4).collect(), 4)
    assert max(sizes.values()) < 1.08 * sum(sizes.values()) / 4


def test_edges(spark):
    assert shard_rows(frame(spark, []), 4).collect() == []
    rows = [(1, None), (2, ""), (2, ""), (None, "é" * 1000)]
    sizes = laws(rows, shard_rows(frame(spark, rows), 4).collect(), 4)
    assert sum(sizes.values()) == 2000 + 4 * OVERHEAD


def test_documents_keep_their_columns(spark):
    df = frame(spark, [(i, f"t{i}", "k", 9) for i in range(50)], ", key string, slot int")
    got = shard_documents(df, 3)
    assert got.columns == ["doc_id", "text", "key", "shard", "slot"]
    assert sorted((x.doc_id, x.text, x.key) for x in got.collect()) == sorted((x.doc_id, x.text, x.key) for x in df.collect())
