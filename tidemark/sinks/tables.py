"""Table sinks: append, overwrite, versioned replace, keyed upsert in place."""

from __future__ import annotations

import math
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.operators.apply import any_null
from tidemark.operators.shape import agree
from tidemark.session import bounded_merges, bounded_partitions, measured_broadcasts, shared_listing
from tidemark.sinks import storage
from tidemark.sinks.keyindex import BUCKET, FILE, KeyDigests, KeyIndex, key_digest
from tidemark.sinks.versions import Files, StaleTableError, Version, VersionLog

__all__ = ["KeyedTable", "MissingTableError", "StaleTableError", "Version", "write_table"]

WRITE = "_write"
#: Buckets of rows without a key, and of rows that are never rewritten.
NO_KEY, SETTLED = -1, -2

BUCKET_BYTES = 4 * 2**30
#: Delta keys of at most so many bytes, summed first, are broadcast.
SMALL_KEY_BYTES = 32 * 2**20
#: Files are about this large; smaller ones are merged when there are several.
FILE_BYTES = 256 * 2**20
#: Files of one folder that are read by their paths; of more, the folder is.
MANY = 64
#: Files that one task of a first load writes where their rows are limited, about.
TASK_FILES = 256
#: Runs of appended files of about one size that are merged into one.
FAN = 8
#: Appended runs start to count as larger from here, and are not merged any more from there.
LEAST_RUN, LARGE_RUN = 2**16, 4 * 2**30
#: Keys for each file of the touched buckets from which nearly every file holds one, so that no index is asked.
DENSE = 8


def bucket_count(table_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table of a given size: a small delta then rewrites a few gigabytes
    per touched bucket, whatever the table's size."""
    return max(1, -(-table_bytes // bucket_bytes))


Change = Callable[[DataFrame, DataFrame, bool], DataFrame]

#: Names that were seen in the folder of a write, by folder, the last asked for last. One write fills a folder before a version names
#: it, and from then on the folder only loses files; so these are all that may be there.
_seen: OrderedDict[str, frozenset[str]] = OrderedDict()
#: Folders of which names are kept.
KEPT_FOLDERS = 256
_lock = threading.Lock()


def _remember(folder: str, names: Iterable[str]) -> frozenset[str]:
    with _lock:
        _seen[folder] = frozenset(names)
        _seen.move_to_end(folder)
        while len(_seen) > KEPT_FOLDERS:
            _seen.popitem(last=False)
        return _seen[folder]


class MissingTableError(RuntimeError):
    """An append was asked for, but the table is not there."""


def write_table(df: DataFrame, table: str, mode: str, path: str | None = None) -> None:
    """``append`` needs the table to exist; ``overwrite`` creates or replaces it."""
    if mode == "append" and not df.sparkSession.catalog.tableExists(table):
        raise MissingTableError(table)
    writer = df.write.mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def create_if_missing(spark: SparkSession, table: str, schema: T.StructType, path: str | None = None) -> None:
    """An empty catalog table of a given shape, unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{place}")


def write_path(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).parquet(path)


def create_empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """An empty table of a given shape."""
    spark.createDataFrame([], schema).write.mode("error").parquet(path)


def replace_table(df: DataFrame, table: str, base: str, drop_old: bool = False) -> str:
    """Full replace readers see at once: write a new version folder, then point the
    table at it. A failed write leaves the old version in place. ``drop_old`` removes
    the other versions, which queries already running may still be reading. Returns the
    folder."""
    spark = df.sparkSession
    version = f"{base.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.mode("error").parquet(version)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{version}'")
    if drop_old:
        for name in storage.children(spark, base):
            if name.startswith("v=") and not version.endswith(name):
                storage.purge(spark, f"{base.rstrip('/')}/{name}")
    return version


@dataclass(frozen=True)
class Applied:
    """What a change did: files of touched buckets that were rewritten, and those that stayed."""

    rewritten: int = 0
    left: int = 0


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet target split into key buckets, so a delta rewrites only files that may hold its keys.

    Every change writes new files beside the old ones, in one job, and then one small file
    that names what was added and dropped. Readers see the old version or the new one; a
    write that dies leaves files that no version names; a token that a writer has
    committed already is not applied again. Keys, bucket count and column types are stored with
    the version, and a delta is brought to them before it is hashed.

    The bucket is a hash of the key's text, so a key may change from int to bigint. Inside the touched buckets an index of
    key ranges and Bloom filters says which files may hold a key of the delta; the others stay. The index is not asked where
    it cannot help: for fewer bytes than ``prune_from``, or a delta of ``DENSE`` keys for each file. Small files of a
    touched bucket are merged when there are several.

    Rows without a key never match anything: they have a bucket of their own that grows by
    files and is only rewritten by changes that ask for it. ``settled`` is a predicate for rows
    that will not change again, as closed versions are; they, appended rows and tables without
    keys fill files that are never rewritten but merged by size: ``fan`` runs of one size become one of the next, so that
    their number grows as the logarithm of the appends. ``keys`` and ``buckets`` are for a new table; ``file_rows`` limits the rows of a
    file, and files of a sixteenth of ``file_bytes`` are small."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64
    settled: str | None = None
    small_bytes: int | None = None
    file_rows: int = 0
    file_bytes: int = FILE_BYTES
    prune_from: int = FILE_BYTES
    fan: int = FAN

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    @property
    def _log(self) -> VersionLog:
        return VersionLog(self.spark, self.path)

    @property
    def index(self) -> KeyIndex:
        return KeyIndex(self.spark, f"{self.path}/index", self.keys)

    def version(self) -> Version | None:
        found = self._log.newest()
        if found and self.keys and found.keys != self.keys:
            raise ValueError(f"{self.path} is keyed by {list(found.keys)}, not {list(self.keys)}")
        return found

    def _known(self) -> Version:
        found = self.version()
        if found is None:
            raise MissingTableError(self.path)
        return found

    def committed(self, writer: str, token: str) -> bool:
        found = self.version()
        return found is not None and found.writers.get(writer) == token

    def last_number(self, writer: str) -> int:
        """The last of a writer's numbered tokens, -1 if it has none."""
        found = self.version()
        return int(found.writers.get(writer, -1)) if found else -1

    def _commit(self, new: Version) -> None:
        self._log.publish(new)

    def _let_go(self, old: Version, new: Version) -> None:
        """Files that the version before the new one had already given up, and old descriptions."""
        live, gone, alone = new.folders, set(), []
        for bucket, name in old.retired:
            folder = (bucket, name.split("/")[0])
            if folder in live:
                alone.append(f"{BUCKET}={bucket}/{WRITE}={name}")
            else:
                gone.add(folder)
        storage.purge_all(self.spark, self.data, alone)
        self._forget(old.retired)
        for bucket, write in gone:
            storage.purge(self.spark, f"{self.data}/{BUCKET}={bucket}/{WRITE}={write}")
        self._log.forget(old.number)

    def _forget(self, files: Iterable[tuple[int, str]]) -> None:
        """What is known of folders, without files that are gone."""
        lost: dict[str, set[str]] = {}
        for bucket, name in files:
            lost.setdefault(self._file(bucket, name.split("/")[0]), set()).add(name)
        with _lock:
            for folder, names in lost.items():
                if folder in _seen:
                    _seen[folder] = _seen[folder] - names

    def _file(self, bucket: int, name: str) -> str:
        return f"{self.data}/{BUCKET}={bucket}/{WRITE}={name}"

    def bucket_of(self, columns: Sequence[str], buckets: int | None = None) -> Column:
        """Where a row belongs. The columns are not needed for it: a row without a key has its own bucket."""
        if not self.keys:
            return F.lit(SETTLED)
        text = [F.col(k).cast("string") for k in self.keys]
        hashed = F.pmod(F.xxhash64(*text), F.lit(buckets or self.buckets)).cast("int")
        return F.when(any_null(self.keys), F.lit(NO_KEY)).otherwise(hashed)

    def _write(self, rows: DataFrame) -> dict[int, dict[str, int]]:
        """Rows with their bucket into new files; returns those of each bucket, with their bytes."""
        write = f"w{uuid.uuid4().hex}"
        rows = rows.withColumn(WRITE, F.lit(write))
        if self.file_rows and self.keys:  # a task's files then have key ranges of their own, in the sort that a write by folders needs anyway
            rows = rows.sortWithinPartitions(BUCKET, WRITE, *self.keys)
        writer = rows.write.mode("append").partitionBy(BUCKET, WRITE)
        try:
            (writer.option("maxRecordsPerFile", self.file_rows) if self.file_rows else writer).parquet(self.data)
        except Exception:
            for folder in storage.matching(self.spark, f"{self.data}/{BUCKET}=*/{WRITE}={write}"):
                storage.purge(self.spark, folder)
            raise
        found: dict[int, dict[str, int]] = {}
        for path, size in storage.sizes(self.spark, storage.matching(self.spark, f"{self.data}/{BUCKET}=*/{WRITE}={write}"), ".parquet"):
            bucket, name = path.split(f"{BUCKET}=")[-1].split(f"/{WRITE}=")
            found.setdefault(int(bucket), {})[name] = size
        for bucket, names in found.items():
            _remember(self._file(bucket, write), names)
        return found

    def _place(self, rows: DataFrame, buckets: int) -> DataFrame:
        place = self.bucket_of(rows.columns, buckets)
        if self.settled:
            place = F.when(F.coalesce(F.expr(self.settled), F.lit(False)), F.lit(SETTLED)).otherwise(place)
        return rows.withColumn(BUCKET, place)

    def create(self, rows: DataFrame, note: Mapping[str, object] | Callable[[DataFrame], Mapping | None] | None = None, append_only: bool = False) -> bool:
        """The table's content is ``rows``, whatever it was. Tables without keys, and those that will only
        be appended to, are written as they are read, without a shuffle. ``note`` may be a function of the rows as they were
        written; if that gives none, nothing is committed and the files go."""
        old = self.version()
        if append_only or not self.keys:
            placed = rows.withColumn(BUCKET, F.lit(SETTLED))
        else:
            placed = self._place(rows, self.buckets).hint("rebalance", BUCKET)
        row_bytes = 8 * len(placed.columns)  # packed, about
        with bounded_merges(self.spark, TASK_FILES * self.file_rows * row_bytes) if self.file_rows else nullcontext():
            files = self._write(placed)
        empty = Version(old.number if old else 0, rows.schema, self.keys, self.buckets, {})
        if callable(note):
            note = note(self._rows(rows.schema, files).drop(BUCKET))
            if note is None:
                for b, names in files.items():
                    for n in names:
                        storage.purge(self.spark, self._file(b, n))
                return False
        gone = tuple((b, n) for b, ns in old.files.items() for n in ns) if old else ()
        new = replace(empty.after(files, {}, note=dict(note or {})), retired=gone)
        self._commit(new)
        if old:
            self._let_go(old, new)
        return True

    def add(self, rows: DataFrame, token: str, writer: str = "", note: Mapping[str, object] | None = None) -> None:
        """Append without matching; a token that the writer committed last adds nothing."""
        old = self._known()
        if old.writers.get(writer) == token:
            return
        schema, rows = agree(old.schema, rows, old.keys)
        files = self._write(rows.withColumn(BUCKET, F.lit(SETTLED)))
        new = old.after(files, {}, schema=schema, writers={**old.writers, writer: token}, note=old.note if note is None else dict(note))
        self._commit(new)
        self._let_go(old, new)
        self.compact()

    def remember(self, note: Mapping[str, object]) -> None:
        """Keep a note with the table, in a version of its own."""
        old = self._known()
        self._commit(replace(old.after({}, {}, note=dict(note)), retired=old.retired))

    def compact(self) -> int:
        """Merges appended runs (what one write added to a bucket) of about one size, until less than ``fan`` of each are left.
        Returns how many runs were merged. A version of its own, which takes no files from readers of the two before."""
        merged = 0
        while True:
            old = self._known()
            runs: dict[tuple[int, int], list[tuple[str, int]]] = {}
            for bucket in (SETTLED, NO_KEY):
                sizes: dict[str, int] = {}
                for name, size in old.files.get(bucket, {}).items():
                    sizes[name.split("/")[0]] = sizes.get(name.split("/")[0], 0) + size
                for write, size in sizes.items():
                    if size < LARGE_RUN:
                        tier = max(0, int(math.log(size / LEAST_RUN, self.fan)) + 1) if size > LEAST_RUN else 0
                        runs.setdefault((bucket, tier), []).append((write, size))
            full = [(key, found) for key, found in sorted(runs.items()) if len(found) >= self.fan]
            if not full:
                return merged
            drop: dict[int, list[str]] = {}
            total: dict[int, int] = {}
            for (bucket, _), found in full:
                writes = {w for w, _ in found}
                drop.setdefault(bucket, []).extend(n for n in old.files[bucket] if n.split("/")[0] in writes)
                total[bucket] = total.get(bucket, 0) + sum(size for _, size in found)
                merged += len(found)
            parts = max(1, -(-sum(total.values()) // self.file_bytes))
            new = old.after(self._write(self._rows(old.schema, drop).coalesce(parts)), drop)
            self._commit(replace(new, retired=old.retired + new.retired))

    def read_open(self) -> DataFrame:
        """The rows that may still change."""
        old = self._known()
        return self._rows(old.schema, {b: f for b, f in old.files.items() if b != SETTLED}).drop(BUCKET)

    def read(self) -> DataFrame:
        old = self._known()
        return self._rows(old.schema, old.files).drop(BUCKET)

    def read_buckets(self, buckets: Sequence[int]) -> DataFrame:
        old = self._known()
        return self._rows(old.schema, {b: old.files[b] for b in buckets if b in old.files}).drop(BUCKET)

    def differing(self, source: DataFrame, deleted: str = "_is_deleted") -> tuple[list[int], DataFrame]:
        """The buckets in which the table's live keys are not the source's, and the source's keys that fall in them.

        Digests of the table's files are kept, so that only files that are new since are read; the source's keys are counted by bucket
        where they are read. Equal digests are taken for equal keys: a number and a sum of 64-bit hashes. Rows without a key are
        a bucket of their own, which differs if the table has any that is live."""
        old = self._known()
        asked = {b: list(names) for b, names in old.files.items() if b != SETTLED}
        facts = KeyDigests(self.spark, f"{self.path}/digests", self.keys)
        unknown = facts.unknown(asked) if asked else {}
        if unknown:
            live = ~F.coalesce(F.col(deleted), F.lit(False)) if deleted in old.schema.names else F.lit(True)
            facts.add(self._rows(old.schema, unknown, named=True).select(*self.keys, BUCKET, FILE, live.alias("_live")))
            facts.tidy(asked)
        _, keys = agree(old.schema, source.select(*self.keys), old.keys)
        keys = keys.select(*self.keys).withColumn(BUCKET, self.bucket_of(self.keys, old.buckets))
        minus = lambda c: (-F.col(c)).alias(c)
        theirs = keys.groupBy(BUCKET).agg(*key_digest(self.keys)).select(BUCKET, minus("n"), minus("total"))
        both = facts.of(asked).select(BUCKET, "n", "total").unionByName(theirs) if asked else theirs
        both = both.groupBy(BUCKET).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("n").alias("most"))
        no_key = (F.col(BUCKET) == NO_KEY) & (F.col("most") > 0)
        found = both.where(F.when(F.col(BUCKET) == NO_KEY, no_key).otherwise((F.col("n") != 0) | (F.col("total") != 0)))
        buckets = sorted(r[BUCKET] for r in found.select(BUCKET).collect())  # at most the table's buckets
        return buckets, keys.where(F.col(BUCKET).isin(buckets) if buckets else F.lit(False)).drop(BUCKET)

    def _rows(self, schema: T.StructType, files: Mapping[int, Sequence[str] | Mapping[str, int]], named: bool = False) -> DataFrame:
        """Stored rows with their bucket and, on request, their file's name; files from before a column was added read it as null."""
        wide = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        paths, others = self._paths(files)
        if not paths:
            empty = self.spark.createDataFrame([], wide)
            return empty.withColumn(FILE, F.lit("")) if named else empty
        full = T.StructType([*wide.fields, T.StructField(WRITE, T.StringType())])
        with shared_listing(self.spark) if sum(map(len, files.values())) > MANY else nullcontext():
            rows = self.spark.read.schema(full).option("basePath", self.data).parquet(*paths)
        if others:  # of the file's path alone, so Spark leaves such files out before it opens any
            listed = ", ".join(f"'{n}'" for n in others)
            rows = rows.where(F.expr(f"substring_index(_metadata.file_path, '/', -3) NOT IN ({listed})"))
        if named:
            return rows.select(*[F.col(f"`{c}`") for c in wide.names], F.concat_ws("/", WRITE, "_metadata.file_name").alias(FILE))
        return rows.drop(WRITE)

    def _paths(self, files: Mapping[int, Sequence[str] | Mapping[str, int]]) -> tuple[list[str], list[str]]:
        """What to read for some files, and what to leave out of that. Spark lists each path it is given, so a folder of which many
        files are wanted is one path; those of its files that are not wanted are named by their last three steps."""
        folders: dict[tuple[int, str], list[str]] = {}
        for b, names in files.items():
            for n in names:
                folders.setdefault((b, n.split("/")[0]), []).append(n)
        paths, others = [], []
        for (b, write), names in folders.items():
            there = self._there(b, write, len(names)) if len(names) > MANY else frozenset()
            if len(names) <= len(there) <= 2 * len(names):
                paths.append(self._file(b, write))
                others += [f"{BUCKET}={b}/{WRITE}={n}" for n in sorted(there.difference(names))]
            else:
                paths += [self._file(b, n) for n in names]
        return paths, others

    def _there(self, bucket: int, write: str, n: int) -> frozenset[str]:
        """Names that may lie in the folder of a write, as versions name them; none if it is not worth a look for ``n`` of them."""
        folder = self._file(bucket, write)
        known = _seen.get(folder)
        if known is not None:
            return _remember(folder, known)
        if not n <= storage.count(self.spark, folder) <= 2 * n:
            return frozenset()
        return _remember(folder, (path.split(f"/{WRITE}=")[-1] for path, _ in storage.sizes(self.spark, [folder], "")))

    def touched(self, delta: DataFrame, buckets: int | None = None) -> dict[int, int]:
        """Buckets the delta falls in, with the bytes of its keys."""
        return {r[BUCKET]: r.b for r in self._hits(delta, buckets)}

    def _hits(self, delta: DataFrame, buckets: int | None = None) -> list[Row]:
        """One row per bucket the delta falls in: its keys' bytes and its rows."""
        size = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 16 for k in self.keys), F.lit(0))
        return delta.groupBy(self.bucket_of(delta.columns, buckets).alias(BUCKET)).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()

    def _held(self, old: Version, delta: DataFrame, hits: Sequence[Row]) -> dict[int, list[str]]:
        """The files that a delta's keys may lie in."""
        asked = {r[BUCKET]: list(old.files[r[BUCKET]]) for r in hits if r[BUCKET] >= 0 and r[BUCKET] in old.files}
        n_files = sum(map(len, asked.values()))
        n_bytes = sum(old.files[b][n] for b, ns in asked.items() for n in ns)
        n_keys = sum(r.n for r in hits if r[BUCKET] >= 0)
        if n_bytes < self.prune_from or n_keys >= DENSE * n_files or n_files <= len(asked):
            return asked
        keys_of = lambda files: self._rows(old.schema, files, named=True).select(*self.keys, BUCKET, FILE)
        unknown = self.index.unknown(asked)
        if unknown:
            self.index.add(keys_of(unknown))
        keys = delta.select(*self.keys, self.bucket_of(delta.columns, old.buckets).alias(BUCKET))
        near = self.index.near(keys, asked)
        bare = self.index.unfiltered(near) if near else {}
        if bare:
            self.index.add_filters(keys_of(bare), bare)
        return self.index.may_hold(keys, near) if near else {}

    def apply(
        self,
        delta: DataFrame,
        change: Change,
        token: str,
        with_no_key: bool = False,
        writer: str = "",
        note: Mapping[str, object] | None = None,
        also: str | None = None,
        matching: bool = True,
    ) -> Applied:
        """Rewrite the files that may hold the delta's keys with ``change(target_rows, delta, small)``.

        ``small`` says that the delta's keys were measured and are safe to broadcast. The
        kept rows then go from scan to file without a shuffle, and only the delta's own
        rows are brought together by bucket. Larger deltas rebalance everything. Rows without a
        key come into ``change`` only if ``with_no_key``, else new ones are added beside them; ``also``
        is a predicate for stored rows, settled ones too, whose files must come in. Without ``matching``
        the delta only adds rows, and just those files come in."""
        old = self._known()
        if old.writers.get(writer) == token:
            return Applied()
        schema, delta = agree(old.schema, delta, old.keys)
        hits = self._hits(delta, old.buckets)
        chosen: dict[int, set[str]] = {b: set(ns) for b, ns in (self._held(old, delta, hits) if matching else {}).items()}
        if with_no_key:
            chosen[NO_KEY] = set(old.files.get(NO_KEY, {}))
        if also:
            for r in self._rows(schema, old.files, named=True).where(F.expr(also)).select(BUCKET, FILE).distinct().collect():
                chosen.setdefault(r[BUCKET], set()).add(r[FILE])
        if not hits and not any(chosen.values()) and note is None:
            return Applied()
        asked = sum(len(old.files.get(r[BUCKET], {})) for r in hits if r[BUCKET] >= 0)
        for b, names in chosen.items():
            little = {n for n, size in old.files.get(b, {}).items() if size < self.file_bytes // 16} if b >= 0 else set()
            if names and len(little - names) >= FAN:
                names |= little
        drop = {b: sorted(names) for b, names in chosen.items() if names}
        small = sum(r.b for r in hits) <= (SMALL_KEY_BYTES if self.small_bytes is None else self.small_bytes)
        fresh = change(self._rows(schema, drop), delta, small)
        schema = T.StructType([f for f in fresh.schema.fields if f.name != BUCKET])
        kept, new = fresh.where(F.col(BUCKET).isNotNull()), fresh.where(F.col(BUCKET).isNull())
        kept, new = self._settle(kept), self._place(new.drop(BUCKET), old.buckets)
        rows = kept.unionByName(new.hint("rebalance", BUCKET)) if small else kept.unionByName(new).hint("rebalance", BUCKET)
        if small:
            with measured_broadcasts(self.spark):
                files: Files = self._write(rows)
        else:  # all rows of the files come into shuffles; how many they are is in the files' footers
            held = self._rows(schema, drop).count()
            packed = sum(old.files[b][n] for b, names in drop.items() for n in names)
            with measured_broadcasts(self.spark), bounded_partitions(self.spark, held + sum(r.n for r in hits), packed / held if held else 2**20):
                files = self._write(rows)
        after = old.after(files, drop, schema=schema, writers={**old.writers, writer: token}, note=old.note if note is None else dict(note))
        self._commit(after)
        self._let_go(old, after)
        self.index.tidy(after.files)
        self.compact()
        rewritten = sum(len(ns) for b, ns in drop.items() if b >= 0)
        return Applied(rewritten, max(0, asked - rewritten))

    def _settle(self, rows: DataFrame) -> DataFrame:
        if not self.settled:
            return rows
        done = F.coalesce(F.expr(self.settled), F.lit(False))
        return rows.withColumn(BUCKET, F.when(done, F.lit(SETTLED)).otherwise(F.col(BUCKET)))

    def vacuum(self) -> int:
        """Remove files that the current version doesn't name, such as dead writes left, with folders that are left empty. No
        writer and no reader of an older version may be at work."""
        old = self._known()
        live = {(b, n) for b, ns in old.files.items() for n in ns}
        gone = 0
        for path in storage.matching(self.spark, f"{self.data}/{BUCKET}=*/{WRITE}=*"):
            bucket, write = path.split(f"{BUCKET}=")[-1].split(f"/{WRITE}=")
            if (int(bucket), write) not in old.folders:
                gone += storage.purge(self.spark, path)
                continue
            for name in storage.children(self.spark, path):
                if (int(bucket), f"{write}/{name}") not in live:
                    gone += storage.purge(self.spark, f"{path}/{name}")
        return gone
