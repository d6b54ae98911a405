"""File sinks: rows per file, size per file, quoting, compression."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.sinks import storage
from tidemark.sources.files import tsv_line
from tidemark.sources.zstd import FRAME_BYTES, write_frames

# Default cut sizes.
ROWS_PER_FILE = 1_000_000
SEGMENT_BYTES = 2**30
QUOTED_BYTES = 50 * 2**20
MANIFEST = "_manifest.json"


def write_rows_per_file(df: DataFrame, path: str, rows: int = ROWS_PER_FILE, mode: str = "error") -> None:
    """Snappy Parquet, at most ``rows`` rows in a file. Tasks write as they read: no shuffle."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).option("compression", "snappy").parquet(path)


def _rolling() -> type[DataSource]:
    """A data source that writes the first column as lines and starts a new file when the next line would not fit.

    It is a class of a function, so that it travels with the job. Tasks write below a hidden folder; the commit
    moves the files of tasks that succeeded, once each, and lists them in the manifest. What failed or repeated tasks
    wrote goes with the hidden folder."""

    @dataclass
    class Parts(WriterCommitMessage):
        parts: list

    class Writer(DataSourceArrowWriter):
        def __init__(self, options: Mapping[str, str]):
            self.place = re.sub(r"^file:/+", "file:///", options["path"])
            self.limit, self.gzip = int(options["partBytes"]), options["gzip"] == "true"
            self.head = options["header"].encode() + b"\n" if options["header"] else b""
            self.hidden = f"_writing-{uuid.uuid4().hex}"

        def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
            store, root = fs.FileSystem.from_uri(self.place)
            store.create_dir(f"{root}/{self.hidden}", recursive=True)
            task, parts, out = TaskContext.get().partitionId(), [], None
            for batch in iterator:
                lines = batch.column(0).cast(pa.large_binary())
                ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
                text = memoryview(lines.buffers()[2] or b"")
                size = ends - ends[0] + np.arange(len(lines) + 1)  # with a line end each
                lo = 0
                while lo < len(lines):
                    room = self.limit - (parts[-1][2] if out else len(self.head))
                    hi = int(np.searchsorted(size, size[lo] + room, "right")) - 1
                    if hi <= lo and out:  # the line does not fit behind others
                        out.close()
                        out = None
                        continue
                    if out is None:
                        name = f"part-{task:05d}-{len(parts):06d}-{uuid.uuid4().hex[:8]}.csv{'.gz' if self.gzip else ''}"
                        parts.append([name, 0, len(self.head)])
                        out = store.open_output_stream(f"{root}/{self.hidden}/{name}", compression="gzip" if self.gzip else None)
                        out.write(self.head)
                        hi = max(hi, lo + 1)  # a line longer than a part is a part of its own
                    whole = np.frombuffer(text[int(ends[lo]) : int(ends[hi])], np.uint8)
                    out.write(np.insert(whole, ends[lo + 1 : hi + 1] - ends[lo], 10).tobytes())
                    parts[-1][1] += hi - lo
                    parts[-1][2] += int(size[hi] - size[lo])
                    lo = hi
            if out:
                out.close()
            return Parts(parts)

        def commit(self, messages: list) -> None:
            store, root = fs.FileSystem.from_uri(self.place)
            store.create_dir(root, recursive=True)
            parts = [p for m in messages if m for p in m.parts]
            for name, _, _ in parts:
                store.move(f"{root}/{self.hidden}/{name}", f"{root}/{name}")
            with store.open_output_stream(f"{root}/{MANIFEST}") as out:
                out.write(json.dumps([{"name": n, "rows": r, "bytes": b} for n, r, b in parts]).encode())
            self.abort(messages)

        def abort(self, messages: list) -> None:
            store, root = fs.FileSystem.from_uri(self.place)
            if store.get_file_info(f"{root}/{self.hidden}").type != fs.FileType.NotFound:
                store.delete_dir(f"{root}/{self.hidden}")

    class Rolling(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_rolling"

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
            return Writer(self.options)

    return Rolling


def write_rolling(lines: DataFrame, path: str, part_bytes: int, header: str = "", gzip: bool = False) -> None:
    """The ``value`` column as text files of at most ``part_bytes`` each (before packing), cut at line ends; a line that is longer is
    a file of its own. Tasks cut the rows they hold as they write them: nothing is shuffled, or measured before. The files, their rows and
    bytes are in ``_manifest.json``."""
    lines.sparkSession.dataSource.register(_rolling())
    told = {"partBytes": str(part_bytes), "header": header, "gzip": str(gzip).lower()}
    lines.select("value").write.format("tidemark_rolling").options(**told).mode("append").save(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, bytes) of the files that one write left."""
    parts = [(p["name"], p["rows"], p["bytes"]) for p in json.loads(storage.read_text(spark, f"{path}/{MANIFEST}"))]
    return spark.createDataFrame(parts, "name string, rows bigint, bytes bigint")


def csv_lines(df: DataFrame, delimiter: str = ",", quote_all: bool = False, **options: str) -> DataFrame:
    """Each row as one delimited line, in the column ``value``."""
    fields = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_csv(fields, {"sep": delimiter, "escape": '"', "quoteAll": str(quote_all).lower(), **options}).alias("value"))


def write_sized_parts(
    df: DataFrame, path: str, part_bytes: int = SEGMENT_BYTES, header: bool = True, gzip: bool = False, delimiter: str = ","
) -> None:
    """CSV cut at line ends into parts of at most ``part_bytes``, be rows ever so unequal."""
    names = [f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & {delimiter, '"', "\n"} else c for c in df.columns]
    write_rolling(csv_lines(df, delimiter), path, part_bytes, delimiter.join(names) if header else "", gzip)


def write_quoted(df: DataFrame, path: str, writers: int = 0, delimiter: str = ",", part_bytes: int = QUOTED_BYTES) -> None:
    """Every value quoted, in files of at most ``part_bytes``; null is an empty value. ``writers`` sets the parallel writers."""
    rows = df.repartition(writers) if writers else df
    write_rolling(csv_lines(rows, delimiter, True, nullValue="", emptyValue=""), path, part_bytes)


def write_tsv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Tab-separated dump with ``\\N`` nulls and backslash escapes."""
    df.select(tsv_line(df).alias("value")).write.option("compression", compression).text(path)


def write_zstd_lines(lines: DataFrame, path: str, frame_bytes: int = FRAME_BYTES) -> None:
    """The ``value`` column as packed text that can be read in parts, one file per partition."""
    write_frames(lines, path, frame_bytes)
