import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pages, warc
from tidemark.session import work_path


def page_rows():
    r = random.Random(1)
    big = "<p>" + "x" * 1200
    rows = [(i, f"http://h/{i}", "".join(r.choice("abé<漢") for _ in range(r.randrange(3000)))) for i in range(60)]
    rows += [(100 + i, "http://same", big) for i in range(5)] + [(200 + i, "http://small", "small") for i in range(3)]
    rows += [(300, None, None), (301, "http://a\r\nWARC-Type: revisit%0D", ""), (None, "http://null", big), (104, "http://again", big), (302, "http://long", "long " * 400_000)]
    return rows


@pytest.fixture(scope="module")
def archive(spark):
    path = work_path(spark, "warc-test")
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    pages.archive(df, path)
    return path


def test_round_trip(spark, archive):
    got = warc.read_warc(spark, archive).collect()
    rows = page_rows()
    assert len(got) == len(rows)
    urn = lambda i: f"urn:page:{'' if i is None else i}"
    full = sorted((x.record_id, x.target_uri or "", x.payload or b"") for x in got if x.record_type == "response")
    revisit = {100, 101, 102, 103, None}
    assert full == sorted((urn(i), u or "", (h or "").encode()) for i, u, h in rows if i not in revisit)
    again = sorted((x.record_id, x.refers_to, x.payload, x.payload_length) for x in got if x.record_type == "revisit")
    assert again == sorted((urn(i), urn(104), None, 1203) for i in revisit)


def test_filters_are_pushed_and_payloads_skipped(spark, archive):
    df = warc.read_warc(spark, archive, payload=False).where("record_type = 'response' AND target_uri LIKE 'http://same%' AND payload_length > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "EqualTo" in plan or "record_type" in plan
    assert [(x.record_id, x.payload) for x in df.collect()] == [("urn:page:104", None)]
    assert warc.read_warc(spark, archive).where("refers_to IS NOT NULL AND NOT record_id = 'urn:page:100'").count() == 4
    assert warc.read_warc(spark, archive).where("record_id IN ('urn:page:1', 'urn:page:2') OR length(payload) = 5").count() == 5


def test_rejected_payloads_are_not_unpacked():
    record = warc.record_bytes(dict(record_type="response", record_id="a", target_uri=None, record_date="d", refers_to=None, payload_digest=None, payload_length=9_000_000, payload=random.Random(1).randbytes(9_000_000)))
    packed = warc.member(record)

    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.read_bytes += len(out)
            return out

    data = packed * 3
    assert list(warc._members(Counting(data), 0, len(data), lambda v: (False, True))) == []
    assert Counting.read_bytes < 100_000


def test_any_gzip_member_and_plain_files(spark, tmp_path):
    """Members without stated lengths, with names, and files that aren't packed, without a manifest."""
    rows = [dict(record_type="response", record_id=f"r{i}", target_uri="http://x", record_date="d", refers_to=None, payload_digest=None, payload_length=n, payload=b"z" * n) for i, n in enumerate([0, 10, 100_000, 5])]
    records = [warc.record_bytes(r) for r in rows]
    named = io.BytesIO()
    with gzip.GzipFile("name", "wb", fileobj=named) as f:
        f.write(records[0])
    (tmp_path / "a.warc.gz").write_bytes(named.getvalue() + b"".join(gzip.compress(r) for r in records[1:]) + warc.member(records[0]))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = sorted((x.record_id, len(x.payload)) for x in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == sorted([(r["record_id"], r["payload_length"]) for r in rows] * 2 + [("r0", 0)])
    assert warc.read_warc(spark, str(tmp_path)).where("record_id = 'r2'").count() == 2


def test_stretches_and_rolled_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SPLIT", 200)
    monkeypatch.setattr(warc, "ROLL", 2000)
    import pyarrow as pa

    rows = [dict(record_type="response", record_id=f"r{i}", target_uri="u", record_date="d", refers_to=None, payload_digest=None, payload_length=1, payload=b"x") for i in range(50)]
    writer = warc.WarcWriter(str(tmp_path))
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows, schema=warc._ARROW)])), None])
    reader = warc.WarcReader(str(tmp_path), True)
    parts = reader.partitions()
    assert len({p.name for p in parts}) > 3 and len(parts) > 10
    (tmp_path / "left-by-a-lost-task.warc.gz").write_bytes(b"torn")
    ids = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("record_id").to_pylist()]
    assert sorted(ids) == sorted(r["record_id"] for r in rows)


def test_empty_and_extra_columns(spark):
    schema = "page_id long, url string, html string, digest string, top long"
    assert pages.archived(spark.createDataFrame([], schema)).collect() == []
    got = pages.archived(spark.createDataFrame([(1, "u", "<p>", "d", 4)], schema)).collect()
    assert [(x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in got] == [(1, 3, "response", None)]


def test_uris_and_ids_come_back_as_they_were(spark):
    uris = ["http://x.com/?q=a%0Ab", "http://x/%0D%25", "http://x/\r\nWARC-Type: revisit", "\n%0A", " http://lead", "http://trail\t", "http://é/漢%C3", "http://x\u0085y", " ", "<http://x>", ""]
    rows = [(f"id{i}", u, "p") for i, u in enumerate(uris)]
    path = work_path(spark, "warc-uris")
    pages.archive(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {x.record_id.removeprefix(pages.URN): x.target_uri for x in warc.read_warc(spark, path).collect()}
    assert got == {i: u for i, u, _ in rows}
    for i, u, _ in rows:
        assert [x.record_id for x in warc.read_warc(spark, path).where(F.col("target_uri") == u).collect()] == [pages.URN + i]
    ids = ["", None, "%", "%00", "%25", "%0Ax", "a\r\nb", " s", "<a>", "plain"]
    big = "<p>" + "y" * 1200
    again = pages.archived(spark.createDataFrame([(i, "u", big) for i in ids], "page_id string, url string, html string")).collect()
    assert sorted((x.page_id is None, x.page_id or "") for x in again) == sorted((i is None, i or "") for i in ids)
    assert {x.refers_to for x in again if x.record_type == "revisit"} == {"plain"}


@pytest.mark.parametrize("payload", [True, False])
def test_each_byte_is_read_once(payload):
    r = random.Random(4)
    records = [warc.record_bytes(dict(record_type="response", record_id=f"r{i}", target_uri="u" * r.randrange(300), record_date="d", refers_to=None, payload_digest=None, payload_length=n, payload=r.randbytes(n))) for i, n in enumerate([0, 10, 3000, 100, 70_000, 5, 400, 30_000] * 30)]

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            Counting.n += len(out)
            return out

    for data, step in ((b"".join(map(warc.member, records)), warc._members), (b"".join(map(gzip.compress, records)), warc._members), (b"".join(records), warc._plain)):
        Counting.n = 0
        got = list(step(Counting(data), 0, len(data), lambda v: (True, payload)))
        assert [x["record_id"] for x in got] == [f"r{i}" for i in range(len(records))] and Counting.n <= 1.2 * len(data)
        assert not payload or [len(x["payload"]) for x in got] == [x["payload_length"] for x in got]
