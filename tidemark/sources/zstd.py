"""Text files packed as several zstd frames: written so that they can be split, and read by many tasks.

A frame can be unpacked without what stands before it. The index of frames stands at the end of the file, in a frame that other
readers skip (the seekable format): the packed and unpacked bytes of each frame. A task takes a run of
frames. Lines may span frames: a task skips up to the first line end of its first frame and reads on to the first
line end behind its last one, as text files are split elsewhere. Files without an index are one run of frames each.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Unpacked bytes of a frame, and packed bytes that make a task.
FRAME_BYTES, TASK_BYTES = 8 << 20, 64 << 20
# Marks of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_FOOT = "<IBI"


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def write_frames(lines: DataFrame, path: str, frame_bytes: int = FRAME_BYTES) -> None:
    """The ``value`` column as packed text, one file per partition, in frames of about ``frame_bytes`` of whole lines with an
    index. A file gets its name when it is whole, and a repeated task replaces its own."""
    foot, skippable, seekable = _FOOT, SKIPPABLE, SEEKABLE  # travel with the function

    def index(frames: list[tuple[int, int]]) -> bytes:
        """A frame that other readers skip: (packed, unpacked) bytes of each frame."""
        table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack(foot, len(frames), 0, seekable)
        return struct.pack("<II", skippable, len(table)) + table

    place = _local(path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.tsv.zst"
        store, root = fs.FileSystem.from_uri(place)
        store.create_dir(root, recursive=True)
        draft, n, frames, packer = f"{root}/.{name}.{uuid.uuid4().hex}", 0, [], zstandard.ZstdCompressor()
        with store.open_output_stream(draft, compression=None) as out:
            held, size = [], 0

            def flush() -> None:
                text = b"".join(held)
                packed = packer.compress(text)
                out.write(packed)
                frames.append((len(packed), len(text)))

            for batch in batches:
                for line in batch.column(0).to_pylist():
                    held.append((line or "").encode() + b"\n")
                    size += len(held[-1])
                    if size >= frame_bytes:
                        flush()
                        held, size = [], 0
                n += batch.num_rows
            if held:
                flush()
            out.write(index(frames))
        store.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    lines.select("value").mapInArrow(pack, "n long").agg(F.sum("n")).collect()


def _source() -> type[DataSource]:
    """The data source as a class of a function, so that it travels with the job."""
    foot, seekable, local = _FOOT, SEEKABLE, _local

    @dataclass
    class Frames(InputPartition):
        path: str
        start: int
        end: int
        stop: int

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.paths, self.task_bytes = [local(p) for p in options["files"].split("\n") if p], int(options["taskBytes"])

        @staticmethod
        def index(store, path: str) -> list[tuple[int, int]]:
            """(start, end) of each frame; one for a file without an index."""
            with store.open_input_file(path) as source:
                size, width = source.size(), struct.calcsize(foot)
                if size > width:
                    n, flags, mark = struct.unpack(foot, source.read_at(width, size - width))
                    entry = 12 if flags & 0x80 else 8
                    if mark == seekable and size >= n * entry + width + 8:
                        table, at, out = source.read_at(n * entry, size - width - n * entry), 0, []
                        for i in range(n):
                            packed = struct.unpack_from("<I", table, i * entry)[0]
                            out.append((at, at + packed))
                            at += packed
                        return out
                return [(0, size)]

        def partitions(self) -> list[InputPartition]:
            out = []
            for path in self.paths:
                store, place = fs.FileSystem.from_uri(path)
                frames = self.index(store, place)
                runs, start = [], 0
                for i, (_, end) in enumerate(frames):
                    if end - frames[start][0] >= self.task_bytes or i == len(frames) - 1:
                        runs.append((frames[start][0], end))
                        start = i + 1
                out += [Frames(path, a, b, frames[-1][1] if frames else 0) for a, b in runs]
            return out or [Frames("", 0, 0, 0)]

        def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
            if not part.path:
                return
            store, place = fs.FileSystem.from_uri(part.path)
            batch = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])
            with store.open_input_file(place) as source:

                def unpacked(start: int, end: int) -> Iterator[bytes]:
                    source.seek(start)
                    left = [end - start]

                    class Limited(io.RawIOBase):
                        def readable(self):
                            return True

                        def readinto(self, target):
                            piece = source.read(min(len(target), left[0]))
                            left[0] -= len(piece)
                            target[: len(piece)] = piece
                            return len(piece)

                    with zstandard.ZstdDecompressor().stream_reader(io.BufferedReader(Limited(), 1 << 20), read_across_frames=True) as stream:
                        while piece := stream.read(1 << 22):
                            yield piece

                rest, skip = b"", part.start > 0
                for piece in unpacked(part.start, part.end):
                    if skip:  # the end of a line of the task before
                        at = piece.find(b"\n")
                        if at < 0:
                            continue
                        piece, skip = piece[at + 1 :], False
                    *lines, rest = (rest + piece).split(b"\n")
                    if lines:
                        yield batch(lines)
                if skip:  # one line from end to end, the task before has it
                    return
                done = False  # up to the first line end of what follows
                for piece in unpacked(part.end, part.stop) if part.end < part.stop else ():
                    at = piece.find(b"\n")
                    rest += piece if at < 0 else piece[:at]
                    if at >= 0:
                        done = True
                        break
                if done or rest:
                    yield batch([rest])

    class ZstdLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_zstd_lines"

        def schema(self) -> T.StructType:
            return T.StructType([T.StructField("value", T.StringType())])

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(self.options)

    return ZstdLines


def read_lines(spark: SparkSession, files: list[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """The lines of packed files, in tasks of about ``task_bytes`` packed bytes."""
    spark.dataSource.register(_source())
    return spark.read.format("tidemark_zstd_lines").options(files="\n".join(files), taskBytes=str(task_bytes)).load()
