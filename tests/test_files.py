"""File formats, escapes, bad records, patterns, sinks."""

from __future__ import annotations

import os
import random
from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import work_path
from tidemark.sinks import files as out
from tidemark.sources import files


def lines_file(spark, label, *texts):
    folder = work_path(spark, label)
    os.makedirs(folder)
    for i, text in enumerate(texts):
        with open(f"{folder}/f{i}.csv", "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TRICKY = ["", "\\N", "\\", "a\tb", "a\nb", "a\r\nb", "\\n", "\\\\t", "tab\\\t", "x\0y", "q\"'", None, "a\bb", "\\Z"]


def test_tsv_round_trip_of_awkward_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i int, t string")
    path = work_path(spark, "tsv")
    out.write_tsv(rows, path)
    assert rows_of(files.read_tsv(spark, path, rows.schema)) == rows_of(rows)


def test_tsv_nulls_zero_dates_and_empty_text(spark):
    folder = lines_file(spark, "tsv", "1\t\\N\t0000-00-00\t\n2\tx\\qy\t2024-02-03\t0000-00-00 00:00:00\n3\n")
    schema = T.StructType.fromDDL("id int, name string, day date, note string")
    assert rows_of(files.read_tsv(spark, folder, schema)) == [
        (1, None, None, ""), (2, "xqy", date(2024, 2, 3), None), (3, None, None, None),
    ]


def test_csv_empty_is_null_and_rows_may_be_ragged(spark):
    folder = lines_file(spark, "csv", '1,"",x\n2,"a ""b"", c"\n3,,y,extra\n')
    got = files.read_csv(spark, folder, "a int, b string, c string")
    assert rows_of(got) == [(1, None, "x"), (2, 'a "b", c', None), (3, None, "y")]


def test_skip_more_than_one_line_in_every_file(spark):
    folder = lines_file(spark, "skip", "h1\nh2\n1;a\n2;b\n", "h1\nh2\n3;'c;d'\n", "h1\n")
    fmt = files.FileFormat(delimiter=";", quote="'", skip_header=2)
    assert rows_of(files.read_declared(spark, folder, fmt, "n int, t string")) == [(1, "a"), (2, "b"), (3, "c;d")]


def test_skip_lines_only_in_the_split_that_starts_the_file(spark):
    body = "".join(f"{i},{'x' * 50}\n" for i in range(3000))
    folder = lines_file(spark, "split", "h\nh\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_declared(spark, folder, files.FileFormat(skip_header=2), "n int, t string")
        assert got.rdd.getNumPartitions() > 3 and got.count() == 3000 and got.where("n IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_strict_read_stops_and_reject_read_sorts_out(spark):
    folder = lines_file(spark, "bad", "1,2.5\nx,3.5\n2,oops\n")
    schema = T.StructType.fromDDL("a int, b double")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_strict(spark, folder, schema, files.FileFormat()).collect()
    bad = files.read_with_rejects(spark, folder, schema, files.FileFormat()).collect()
    assert sorted(r[files.CORRUPT] for r in bad if r[files.CORRUPT]) == ["2,oops", "x,3.5"]


def test_names_match_without_case_and_absent_columns_are_null(spark):
    path = work_path(spark, "names")
    spark.range(2).select(F.col("id").alias("Cust_Key")).write.parquet(path)
    got = files.read_by_name(spark, path, T.StructType.fromDDL("CUST_KEY bigint, EXTRA string"))
    assert rows_of(got) == [(0, None), (1, None)]


def test_pattern_reads_only_matching_files(spark):
    path = work_path(spark, "pattern")
    for name in ("a", "b", "c"):
        spark.createDataFrame([(name,)], "v string").write.parquet(f"{path}/{name}")
    with open(f"{path}/b/broken.parquet", "w") as f:
        f.write("not a parquet file")  # opening it would fail
    got = files.read_matching(
        lambda s: s.read.schema("v string").option("recursiveFileLookup", True).parquet(path), spark, r".*/(a|c)/.*"
    )
    assert rows_of(got) == [("a",), ("c",)]


def test_nothing_to_load(spark):
    assert files.load_or_none(lambda: spark.read.parquet("/no/such/folder")) is None
    assert files.load_or_none(lambda: spark.range(0)) is None
    assert files.load_or_none(lambda: spark.range(1)) is not None


def test_dated_path():
    assert files.dated_path("s3://b/x/", date(2024, 1, 31)) == "s3://b/x/20240131/"
    assert files.dated_path("s3://b/x", None) == "s3://b/x/"


def test_rows_per_file_limit(spark):
    path = work_path(spark, "limit")
    out.write_rows_per_file(spark.range(0, 100, 1, 1), path, 30)
    counts = [r.n for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).agg(F.count("*").alias("n")).collect()]
    assert sorted(counts) == [10, 30, 30, 30]


def test_sized_parts_have_headers_and_about_the_size(spark):
    path = work_path(spark, "sized")
    rows = spark.range(0, 10_000, 1, 1).select("id", F.lit("x" * 20).alias("t"))
    out.write_sized_parts(rows, path, 50_000)
    parts = [f"{path}/{n}" for n in os.listdir(path) if n.endswith(".csv")]
    assert len(parts) >= 5 and all(os.path.getsize(p) < 60_000 for p in parts)
    assert all(open(p).readline() == "id,t\n" for p in parts)
    assert files.read_csv(spark, path, rows.schema, files.FileFormat(skip_header=1)).count() == 10_000


def test_quoted_sink_quotes_everything(spark):
    path = work_path(spark, "quoted")
    out.write_quoted(spark.createDataFrame([(1, 'a"b'), (2, None)], "i int, t string"), path)
    text = "".join(open(f"{path}/{n}").read() for n in os.listdir(path) if n.endswith(".csv"))
    assert sorted(text.splitlines()) == ['"1","a""b"', '"2",""']


def test_tsv_bad_lines_end_the_load_or_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\n2x\ty\n3\tz\tmore\n4\n\\N\t\\N\n")
    schema = T.StructType.fromDDL("k bigint, v string")
    with pytest.raises(Exception, match="is no bigint|more than 2 fields"):
        files.read_tsv(spark, str(tmp_path), schema).collect()
    got = files.read_tsv(spark, str(tmp_path), schema, rejects=True).collect()
    assert [r.k for r in got if r[files.CORRUPT] is None] == [1, 4, None]
    assert sorted(r[files.CORRUPT] for r in got if r[files.CORRUPT]) == ["2x\ty", "3\tz\tmore"]


def test_packed_dumps_are_read_in_pieces(spark, tmp_path):
    import pyarrow as pa

    lines = "".join(f"{i}\tv{i}\n" for i in range(300_000)).encode()
    with pa.CompressedOutputStream(str(tmp_path / "a.tsv.zst"), "zstd") as out:
        out.write(lines)
    (tmp_path / "b.tsv").write_text("-1\tplain\n")
    got = files.read_tsv(spark, str(tmp_path), T.StructType.fromDDL("k bigint, v string"))
    assert (got.count(), got.agg({"k": "sum"}).first()[0]) == (300_001, sum(range(300_000)) - 1)


def test_short_rows_are_allowed_and_bad_values_are_not(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2\n")
    schema = T.StructType.fromDDL("k bigint, v string")
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path), schema).collect()) == [(1, "x"), (2, None)]
    (tmp_path / "b.csv").write_text("no,x\n")
    with pytest.raises(Exception, match="k is no bigint"):
        files.read_csv(spark, str(tmp_path), schema).collect()


def test_lines_are_skipped_in_the_file_they_start(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_text("h1\nh2\nh3\n" + "".join(f"{n * 1000 + i},x\n" for i in range(1000)))
    fmt = files.FileFormat(skip_header=3)
    got = files.read_declared(spark, str(tmp_path), fmt, T.StructType.fromDDL("k int, v string"))
    assert sorted(r.k for r in got.collect()) == sorted(n * 1000 + i for n in range(3) for i in range(1000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert files.read_declared(spark, str(tmp_path), fmt, T.StructType.fromDDL("k int, v string")).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("frame, task", [(1, 1), (60, 1), (200, 300), (1 << 20, 1)])
def test_packed_lines_are_read_once_wherever_frames_end(spark, frame, task):
    from tidemark.sources import zstd

    r = random.Random(frame)
    lines = ["x" * r.choice([0, 1, 30, 500]) + str(i) for i in range(300)] + [""]
    path = work_path(spark, "frames")
    zstd.write_frames(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), path, frame)
    place = f"{path}/part-00000.tsv.zst"
    got = zstd.read_lines(spark, [place], task)
    assert sorted(x.value for x in got.collect()) == sorted(lines)
    assert (got.rdd.getNumPartitions() > 1) == (frame < 1 << 20)


def test_packed_lines_may_span_frames(spark):
    import struct

    import zstandard

    text = ("\n".join(["a" * 50, "", "b" * 700, "c", "d" * 10])).encode()
    for cut in (1, 7, 51, 52, 53, 100, 400):
        pieces = [text[i : i + cut] for i in range(0, len(text), cut)]
        packed = [zstandard.ZstdCompressor().compress(p) for p in pieces]
        table = b"".join(struct.pack("<II", len(p), len(q)) for p, q in zip(packed, pieces)) + struct.pack("<IBI", len(packed), 0, 0x8F92EAB1)
        folder = work_path(spark, "frames").removeprefix("file:")
        os.makedirs(folder)
        for name, tail in (("indexed", struct.pack("<II", 0x184D2A5E, len(table)) + table), ("plain", b"")):
            with open(f"{folder}/{name}.zst", "wb") as out_:
                out_.write(b"".join(packed) + tail)
            from tidemark.sources import zstd

            got = zstd.read_lines(spark, [f"{folder}/{name}.zst"], 1)
            assert [x.value for x in got.collect()] == text.decode().split("\n"), (cut, name)
            assert got.rdd.getNumPartitions() == (len(pieces) if name == "indexed" else 1)


def test_rows_with_more_fields_than_columns_end_the_load_on_request(spark):
    def read(*lines, **extras):
        path = work_path(spark, "csv")
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        return files.read_csv(spark, path, "a int, b string", files.FileFormat(extras=extras), extra_fields="fail")

    assert sorted(tuple(r) for r in read("1,x", '2,"y, z"', "3").collect()) == [(1, "x"), (2, "y, z"), (3, None)]
    for bad in ("1,a,EXTRA", '1,a,"E"', "1,a,,E", "1,a,", ",,"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            read("1,x", bad).collect()
        with pytest.raises((PySparkException, Py4JJavaError)):
            read("1,x", bad).select("a").collect()
