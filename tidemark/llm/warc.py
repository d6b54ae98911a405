"""WARC archives as a PySpark Python data source.

Files hold one gzip member per record. A member states its own length in its gzip header (extra
field ``sl``: packed and unpacked length), so a reader can step over it unread. The writer rolls
files at ``ROLL`` bytes and lists each finished file, with the record starts about every ``SPLIT`` bytes, in
a manifest written on commit: what a failed or repeated task left is not in it. The reader plans one
partition per listed stretch; each unpacks a member's first bytes, parses the headers, tests the
pushed filters on them, and unpacks the payload only of records that pass, and only if it is asked
for. Batches are bounded by bytes. Files without a manifest, or members without stated lengths,
are read whole and in order.

Paths may be any URI that ``pyarrow.fs`` can open and that driver and executors share.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

ROLL, SPLIT = 1 << 30, 1 << 26
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
MANIFEST = "_files.json"
SCHEMA = "record_type string, record_id string, target_uri string, record_date string, refers_to string, payload_digest string, payload_length long, payload binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in _NAMES])
#: Columns held by headers of these names.
_HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Names the columns whose values are percent-encoded, since a header cannot hold them as they are.
_ENCODED = "X-Percent-Encoded"
_PLAIN = "".join(chr(c) for c in range(33, 127) if c != 37)


def _line(row: dict, column: str, encoded: list[str]) -> str:
    """A header value as it is, unless it has line ends or white space around it; such a one is encoded and noted."""
    value = row[column]
    if "\r" not in value and "\n" not in value and value == value.strip():
        return value
    encoded.append(column)
    return quote(value, safe=_PLAIN)


def record_bytes(row: dict) -> bytes:
    """One record, unpacked. Digests are SHA-1 in hex in columns and in base 32 in headers; a revisit keeps
    the HTTP head, with the full payload's length, and no payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + payload
    encoded: list[str] = []
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_line(row, 'record_id', encoded)}>", f"WARC-Date: {row['record_date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row, 'target_uri', encoded)}")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_line(row, 'refers_to', encoded)}>"]
    if encoded:
        lines.append(f"{_ENCODED}: {' '.join(encoded)}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member that states its lengths, if they fit four bytes each."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 10 + 14 + len(body) + 8
    if max(total, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.path)
        files, out = [], None
        try:
            for batch in iterator:
                columns = [batch.column(n) for n in _NAMES]
                for i in range(batch.num_rows):
                    if out is None:
                        files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "bytes": 0, "starts": [0]})
                        out = store.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    packed = member(record_bytes({n: c[i].as_py() for n, c in zip(_NAMES, columns)}))
                    now = files[-1]
                    if now["bytes"] - now["starts"][-1] >= SPLIT:
                        now["starts"].append(now["bytes"])
                    out.write(packed)
                    now["bytes"] += len(packed)
                    if now["bytes"] >= ROLL:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        listed = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps(listed).encode())
        store.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Written | None]) -> None:
        """Files that no manifest lists are never read; nothing is removed."""


@dataclass
class Stretch(InputPartition):
    name: str
    start: int
    end: int | None


_TESTS = {
    EqualTo: lambda f, v: v is not None and v == f.value,
    EqualNullSafe: lambda f, v: v == f.value,
    In: lambda f, v: v is not None and v in f.value,
    GreaterThan: lambda f, v: v is not None and v > f.value,
    GreaterThanOrEqual: lambda f, v: v is not None and v >= f.value,
    LessThan: lambda f, v: v is not None and v < f.value,
    LessThanOrEqual: lambda f, v: v is not None and v <= f.value,
    IsNull: lambda f, v: v is None,
    IsNotNull: lambda f, v: v is not None,
    StringStartsWith: lambda f, v: v is not None and v.startswith(f.value),
    StringEndsWith: lambda f, v: v is not None and v.endswith(f.value),
    StringContains: lambda f, v: v is not None and f.value in v,
}


def _passes(f: Filter, values: dict) -> bool:
    if isinstance(f, Not):
        value = values[f.child.attribute[0]]
        return (value is not None or isinstance(f.child, (EqualNullSafe, IsNull, IsNotNull))) and not _passes(f.child, values)
    return _TESTS[type(f)](f, values[f.attribute[0]])


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if type(inner) in _TESTS and len(inner.attribute) == 1 and inner.attribute[0] in (*_HEADERS, "payload_length"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as source:
                listed = json.loads(source.read())
            return [Stretch(f["name"], a, b) for f in listed for a, b in zip(f["starts"], [*f["starts"][1:], f["bytes"]])]
        found = store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
        return [Stretch(i.base_name, 0, None) for i in found if i.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without records
            return
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as source:
            rows, held = [], 0
            end = source.size() if partition.end is None else partition.end
            step = _members if partition.name.endswith(".gz") else _plain
            for record in step(source, partition.start, end, self._wanted):
                rows.append(record)
                held += len(record["payload"] or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _wanted(self, values: dict) -> tuple[bool, bool]:
        """Whether the record passes, and whether its payload is needed."""
        return all(_passes(f, values) for f in self.filters), self.payload and values["record_type"] != "revisit"


def _parse(head: bytes) -> tuple[dict, int, int, int] | None:
    """Column values, where the block begins, its length, and the HTTP head's length; None if ``head`` is cut short."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    version, *lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    values = {c: fields.get(h.lower()) for c, h in _HEADERS.items()}
    encoded = fields.get(_ENCODED.lower(), "").split()
    for c in ("record_id", "refers_to", "target_uri"):
        v = values[c]
        if v is not None:
            v = v[1:-1] if c != "target_uri" and v.startswith("<") and v.endswith(">") else v
            values[c] = unquote(v) if c in encoded else v
    digest = values["payload_digest"]
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        values["payload_digest"] = base64.b32decode(digest[5:]).hex()
    inner, size = 0, length
    if "application/http" in fields.get("content-type", ""):
        stop = head.find(b"\r\n\r\n", end + 4)
        if stop < 0 and len(head) < end + 4 + length:
            return None
        inner = stop + 4 - (end + 4) if stop >= 0 else length
        http = head[end + 4 : end + 4 + inner].lower()
        size = length - inner
        if values["record_type"] == "revisit" and b"content-length:" in http:
            size = int(http.split(b"content-length:")[1].split(b"\r\n")[0])
    values["payload_length"] = size
    return values, end + 4, length, inner


#: Bytes that are read after a step over others, and most that are read at once while records follow each other.
_LEAST_READ, _MOST_READ = 1 << 14, 1 << 20


class _Window:
    """The bytes of a file from some place on, read once as the place moves forward."""

    def __init__(self, source, end: int):
        self.source, self.end, self.start, self.data, self.step = source, end, 0, b"", _LEAST_READ

    def at(self, place: int, least: int, end: int | None = None) -> bytes:
        """Bytes from ``place`` on: ``least`` of them or all there are, and what else was read, up to ``end``."""
        if not self.start <= place <= self.start + len(self.data):
            self.data, self.step = b"", _LEAST_READ
        else:
            self.data = self.data[place - self.start :]
        self.start = place
        while len(self.data) < least and place + len(self.data) < self.end:
            self.source.seek(place + len(self.data))
            piece = self.source.read(min(self.end - place - len(self.data), max(self.step, least - len(self.data))))
            if not piece:
                break
            self.data += piece
            self.step = min(2 * self.step, _MOST_READ)
        return self.data if end is None else self.data[: max(0, end - place)]


def _members(source, start: int, end: int, wanted) -> Iterator[dict]:
    at, window = start, _Window(source, end)
    while at < end:
        packed = window.at(at, 1 << 12)
        skip, total = 10, None
        if packed[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        flags = packed[3]
        if flags & 4:
            (length,) = struct.unpack_from("<H", packed, 10)
            packed = window.at(at, 12 + length + (1 << 12))
            if packed[12:14] == b"sl":
                total = struct.unpack_from("<I", packed, 16)[0]
            skip = 12 + length
        for bit in (8, 16):  # a name, a comment
            if flags & bit:
                while (stop := packed.find(b"\0", skip)) < 0 and len(packed) < end - at:
                    packed = window.at(at, 2 * len(packed))
                if stop < 0:
                    raise ValueError(f"the member at byte {at} is cut short")
                skip = stop + 1
        skip += 2 * bool(flags & 2)
        stop = end if total is None else at + total
        packed = packed[: stop - at]
        unpack, record, taken, feed = zlib.decompressobj(-zlib.MAX_WBITS), bytearray(), len(packed), packed[skip:]

        def more(limit: int) -> bool:
            """Unpack some more, ``limit`` bytes at most; false at the member's end."""
            nonlocal feed, taken
            if unpack.eof:
                return False
            if not feed:
                feed = window.at(at + taken, 1, stop)
                taken += len(feed)
                if not feed:
                    raise ValueError(f"the member at byte {at} is cut short")
            record.extend(unpack.decompress(feed, limit))
            feed = unpack.unconsumed_tail
            return True

        parsed = None
        while parsed is None and more(1 << 12):
            parsed = _parse(bytes(record))
        if parsed is None:
            raise ValueError(f"the record at byte {at} has no headers")
        values, begin, length, inner = parsed
        passes, payload = wanted(values)
        if passes and payload or total is None:  # without a stated length the member's end must be found
            while more(1 << 20):
                pass
        if passes:
            values["payload"] = bytes(record[begin + inner : begin + length]) if payload else None
            yield values
        at = stop if total is not None else min(at + taken - len(unpack.unused_data) + 8, end)


def _plain(source, start: int, end: int, wanted) -> Iterator[dict]:
    """Records that aren't packed: payloads that aren't wanted are stepped over."""
    at, window = start, _Window(source, end)
    while at < end:
        head = window.at(at, 1 << 12)
        while (parsed := _parse(head)) is None:
            if len(head) >= end - at:
                raise ValueError(f"the record at byte {at} is cut short")
            head = window.at(at, 2 * len(head))
        values, begin, length, inner = parsed
        passes, payload = wanted(values)
        if passes:
            values["payload"] = None
            if payload:
                values["payload"] = window.at(at + begin + inner, length - inner)[: length - inner]
            yield values
        at += begin + length + 4


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (default true): whether readers unpack payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(_uri(self.options["path"]), self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        path = _uri(self.options["path"])
        store, root = fs.FileSystem.from_uri(path)
        if not overwrite and store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            raise ValueError(f"{path} holds an archive; write with mode overwrite or elsewhere")
        store.create_dir(root, recursive=True)
        return WarcWriter(path)


def _uri(path: str) -> str:
    """``file:/x``, as Spark writes it, and plain paths as URIs."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path


def write_warc(records: DataFrame, path: str) -> None:
    """Write records, with the columns of ``SCHEMA``, as an archive at a new or overwritten ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*_NAMES).write.format("warc").mode("overwrite").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive. Turns on filter pushdown for Python data sources in this session."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
