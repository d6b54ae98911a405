"""Folders in shared storage, through the file systems Spark itself uses."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tidemark.session import shared_listing

#: Files that are asked for their bytes one by one; more are asked by a Spark job.
ONE_BY_ONE = 1000
#: Files that are removed at a time.
AT_ONCE = 8


def _handle(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _handle(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _handle(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def purge(spark: SparkSession, path: str) -> bool:
    fs, target = _handle(spark, path)
    return fs.delete(target, True)


def purge_all(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Many files of one file system, named from a folder that they all lie below."""
    fs, _ = _handle(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda name: fs.delete(path(f"{folder}/{name}"), True), names))


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, target = _handle(spark, path)
    place = _handle(spark, to)[1]
    fs.mkdirs(place.getParent())
    if not fs.rename(target, place):
        raise OSError(f"could not move {path} to {to}")


def archive_path(root: str, kind: str, day: str, name: str) -> str:
    """Where loaded files go: ``processed/<kind>/<day>/<name>``."""
    return f"{root.rstrip('/')}/processed/{kind}/{day}/{name}"


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches."""
    fs, target = _handle(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(target) or []))


def sizes(spark: SparkSession, folders: Iterable[str], ending: str) -> list[tuple[str, int]]:
    """Paths of the files in some folders, with their bytes."""
    found, many, n = [], [], 0
    for folder in folders:
        fs, target = _handle(spark, folder)
        inside = fs.listStatus(target)
        n += len(inside)
        if n > ONE_BY_ONE:
            many.append(folder)
        else:
            found += [(s.getPath().toString(), s.getLen()) for s in inside]
    if many:
        with shared_listing(spark):
            found += [tuple(r) for r in spark.read.format("binaryFile").load(many).select("path", "length").collect()]
    return sorted((path, size) for path, size in found if path.endswith(ending))


def count(spark: SparkSession, folder: str) -> int:
    """How many files and folders lie in a folder."""
    fs, target = _handle(spark, folder)
    return len(fs.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _handle(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _handle(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new small file that appears whole; false if it is there already."""
    fs, target = _handle(spark, path)
    if fs.exists(target):
        return False
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    _create_text(spark, draft, text)
    return fs.rename(_handle(spark, draft)[1], target)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file's new content."""
    _create_text(spark, path, text)
