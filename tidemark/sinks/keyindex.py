"""Which files of a table may hold a key: a key range and a Bloom filter for each file.

Entries are derived from files that never change, so they are made when a delta first asks for them, and kept beside the
table as Parquet: a file's range when the file is first asked for, its filter when a key first lies in that range. A filter is cut
into pages of 4 KiB, one row each; a lookup reads the pages its keys fall in. All of it is
DataFrame work: bits are set by ``bitmap_construct_agg``, and keys meet ranges and pages by joins. The driver gets
names of files, at most those it asked about.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.operators.apply import no_nulls
from tidemark.sinks import storage
from tidemark.sources.files import load_or_none

BUCKET, FILE = "_bucket", "_file"
#: Bits of a filter for each key, bits set for it, and bits of a page.
BITS, HASHES, PAGE = 16, 4, 32_768
#: Blocks that all key ranges of files are cut into, about.
BLOCKS = 1 << 20
#: Folders of entries before they are written as one.
FOLDERS = 16
_ENTRY = f"{BUCKET} int, {FILE} string, low bigint, high bigint, pages bigint, page bigint, bits binary"


def ordinal(field: T.StructField) -> Column:
    """A number that orders a key's values as they are ordered; null for kinds that have none."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp"))
    return F.lit(None).cast("long")


def key_hash(keys: Sequence[str]) -> Column:
    """Of the keys' texts, so a key may become wider."""
    return F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys])


def _spots(pages: Column) -> Column:
    """The places of a key ``h`` in a filter of so many pages."""
    place = F.array(*[F.pmod(F.xxhash64("h", F.lit(i)), pages * PAGE) for i in range(HASHES)])
    return F.transform(F.array_distinct(place), lambda p: F.struct(F.floor(p / PAGE).alias("page"), (p % PAGE).alias("bit")))


def _inside(asked: DataFrame, tops: DataFrame) -> DataFrame:
    """Keys with the files of their bucket whose range they lie in. Ranges are cut into blocks, about ``BLOCKS`` and one for each
    file, and a key meets the ranges of its block only. Where either side has no order, all files of the bucket are met."""
    ends = tops.where("low IS NOT NULL")
    width = F.col("high").cast("decimal(38,0)") - F.col("low") + 1
    bits = int(ends.agg(F.sum(width.cast("double"))).first()[0] or 1).bit_length() - BLOCKS.bit_length()
    bits = min(max(bits, 0), 63)
    block = lambda c: F.shiftright(F.col(c), bits)
    cut = ends.repartition(tops.sparkSession.sparkContext.defaultParallelism)  # few bytes, but about ``BLOCKS`` rows once they are cut
    cut = cut.select("*", F.explode(F.sequence(block("low"), block("high"))).alias("_block"))
    near = asked.where("o IS NOT NULL").withColumn("_block", block("o")).join(cut, [BUCKET, "_block"])
    near = near.where(F.col("o").between(F.col("low"), F.col("high"))).drop("_block")
    loose = asked.join(tops.where("low IS NULL"), BUCKET).unionByName(asked.where("o IS NULL").join(ends, BUCKET))
    return near.unionByName(loose)


@dataclass(frozen=True)
class PerFile:
    """Facts about a table's files, kept beside it as Parquet. Files never change, so neither do their facts."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    ENTRY = ""

    def entries(self) -> DataFrame | None:
        return load_or_none(lambda: self.spark.read.schema(f"{self.ENTRY}, write string").parquet(self.path).drop("write"))

    def of(self, files: Mapping[int, Sequence[str]]) -> DataFrame:
        return self.entries().join(F.broadcast(self._names(files)), [BUCKET, FILE], "left_semi")

    def known(self, files: Mapping[int, Sequence[str]], kind: str = "true") -> set[tuple[int, str]]:
        """Those of ``files`` that have entries of a kind."""
        return set() if self.entries() is None else {tuple(r) for r in self.of(files).where(kind).select(BUCKET, FILE).distinct().collect()}

    def unknown(self, files: Mapping[int, Sequence[str]], kind: str = "true") -> dict[int, list[str]]:
        known = self.known(files, kind)
        left = {b: [n for n in names if (b, n) not in known] for b, names in files.items()}
        return {b: names for b, names in left.items() if names}

    def _put(self, entries: DataFrame) -> str:
        name = f"write={uuid.uuid4().hex}"
        entries.write.parquet(f"{self.path}/{name}")
        return name

    def tidy(self, live: Mapping[int, Sequence[str]]) -> None:
        """Many folders become one, without the entries of files that are gone."""
        old = [n for n in storage.children(self.spark, self.path) if n.startswith("write=")]
        if len(old) < FOLDERS:
            return
        kept = self._put(self.of(live))
        for name in old:
            if name != kept:
                storage.purge(self.spark, f"{self.path}/{name}")

    def _names(self, files: Mapping[int, Sequence[str]]) -> DataFrame:
        """File names as rows: as many as the driver named."""
        return self._numbers([(b, n) for b, ns in files.items() for n in ns]).drop("_n")

    def _numbers(self, listed: Sequence[tuple[int, str]]) -> DataFrame:
        buckets, names = pa.array([b for b, _ in listed], pa.int32()), pa.array([n for _, n in listed], pa.string())
        return self.spark.createDataFrame(pa.table({BUCKET: buckets, FILE: names, "_n": pa.array(range(len(listed)), pa.int32())}))


class KeyDigests(PerFile):
    """The number and the sum of hashes of the live keys of each file; digests of files add up to digests of buckets."""

    ENTRY = f"{BUCKET} int, {FILE} string, n bigint, total decimal(38,0)"

    def add(self, rows: DataFrame) -> None:
        """For all files of ``rows`` (keys, ``_bucket``, ``_file``, ``_live``)."""
        self._put(rows.groupBy(BUCKET, FILE).agg(*key_digest(self.keys, F.col("_live"))))


def key_digest(keys: Sequence[str], live: Column | None = None) -> list[Column]:
    hashed = key_hash(keys).cast("decimal(38,0)")
    counted = F.lit(True) if live is None else live
    return [F.count_if(counted).alias("n"), F.coalesce(F.sum(F.when(counted, hashed)), F.lit(0)).cast("decimal(38,0)").alias("total")]


class KeyIndex(PerFile):
    """A file's range is an entry without a page; those of its filter repeat it."""

    ENTRY = _ENTRY

    def _sizes(self, each: DataFrame) -> DataFrame:
        pages = F.ceil(F.count("*") * BITS / PAGE)
        return each.groupBy(BUCKET, FILE).agg(F.min("o").alias("low"), F.max("o").alias("high"), pages.alias("pages"))

    def _keys(self, rows: DataFrame, *columns: str) -> DataFrame:
        hashed, order = key_hash(self.keys).alias("h"), ordinal(rows.schema[self.keys[0]]).alias("o")
        return rows.where(no_nulls(self.keys)).select(BUCKET, *columns, hashed, order)

    def add(self, rows: DataFrame) -> None:
        """Ranges of all files that ``rows`` (keys, ``_bucket``, ``_file``) come from."""
        sizes = self._sizes(self._keys(rows, FILE))
        self._put(sizes.withColumns({"page": F.lit(None).cast("bigint"), "bits": F.lit(None).cast("binary")}))

    def unfiltered(self, files: Mapping[int, Sequence[str]]) -> dict[int, list[str]]:
        return self.unknown(files, "page IS NOT NULL")

    def add_filters(self, rows: DataFrame, files: Mapping[int, Sequence[str]]) -> None:
        """Filters of ``files``, which ``rows`` come from: as many as the driver named, so their sizes are broadcast."""
        sizes = self.of(files).select(BUCKET, FILE, "low", "high", "pages").distinct()
        each = self._keys(rows, FILE).drop("o").join(F.broadcast(sizes), [BUCKET, FILE])
        spots = each.select(BUCKET, FILE, "low", "high", "pages", F.explode(_spots(F.col("pages"))).alias("at"))
        group = [BUCKET, FILE, "low", "high", "pages", F.col("at.page").alias("page")]
        self._put(spots.groupBy(*group).agg(F.bitmap_construct_agg(F.col("at.bit")).alias("bits")).repartition(FILE))

    def near(self, delta: DataFrame, files: Mapping[int, Sequence[str]]) -> dict[int, list[str]]:
        """Those of ``files`` in whose range a key of ``delta`` lies, which has its ``_bucket``. All must have a range."""
        numbered, named = self._numbered(files)
        tops = numbered.select(BUCKET, FILE, "low", "high", "pages").distinct()
        return named(_inside(self._keys(delta).distinct(), tops))

    def may_hold(self, delta: DataFrame, files: Mapping[int, Sequence[str]]) -> dict[int, list[str]]:
        """Those of ``files`` that may hold a key of ``delta``. All must have filters."""
        numbered, named = self._numbered(files)
        entries = numbered.where("page IS NOT NULL")
        tops = entries.select(BUCKET, FILE, "low", "high", "pages").distinct()
        pairs = _inside(self._keys(delta).distinct(), tops).select(BUCKET, FILE, "h", _spots(F.col("pages")).alias("at"))
        spots = pairs.select(BUCKET, FILE, "h", F.size("at").alias("n"), F.explode("at").alias("at"))
        spots = spots.select(BUCKET, FILE, "h", "n", F.col("at.page").alias("page"), F.col("at.bit").alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
        found = spots.join(entries.select(BUCKET, FILE, "page", "bits"), [BUCKET, FILE, "page"]).where(hit)
        return named(found.groupBy(BUCKET, FILE, "h").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n"))

    def _numbered(self, files: Mapping[int, Sequence[str]]) -> tuple[DataFrame, Callable[[DataFrame], dict[int, list[str]]]]:
        """Entries of ``files`` with a number in place of a file's name, which pairs of keys and files would carry along, and what
        names the different files of such rows."""
        listed = [(b, n) for b, names in files.items() for n in names]
        rows = self.entries().join(F.broadcast(self._numbers(listed)), [BUCKET, FILE]).drop(FILE).withColumnRenamed("_n", FILE)

        def named(found: DataFrame) -> dict[int, list[str]]:
            out: dict[int, list[str]] = {}
            for r in found.select(FILE).distinct().collect():
                b, name = listed[r[FILE]]
                out.setdefault(b, []).append(name)
            return out

        return rows, named
