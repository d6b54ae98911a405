"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows for which a shuffle has a partition at least, and rows that a task takes of merged ones, where a job's rows are known.
PARTITION_ROWS, TASK_ROWS = 250_000, 500_000
_PARTITIONS, _ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_PLANNED, _SEEN = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_LISTED, _LISTERS = "spark.sql.sources.parallelPartitionDiscovery.threshold", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_lock = threading.RLock()
_asked: list[object] = []
_before: dict[str, str | None] = {}

# Settings every job here relies on. AQE re-plans joins from the sizes it sees,
# so small sides are broadcast only after their size is known.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def settings_for(data_bytes: int, most_partitions: int = 50_000) -> dict[str, str]:
    """Partition settings for a job over about ``data_bytes``.

    Input splits of 512 MiB and shuffle partitions of about 1 GiB, at most ``most_partitions``: the
    driver tracks every pair of map task and shuffle partition, so neither may grow
    without end. AQE merges small partitions and splits skewed ones."""
    parts = min(most_partitions, max(200, -(-data_bytes // 2**30)))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 * 2**20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 2**20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2**30),
    }


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _size(text: str) -> int:
    """Bytes, as Spark's settings write them."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


@contextmanager
def _held(spark: SparkSession, wish: Callable[[], Mapping[str, object]]) -> Iterator[None]:
    """A wish's settings until all who asked are done, then what was set before. Several threads may ask."""
    mine = object()
    with _lock:
        if not _asked:
            _before.update({name: spark.conf.get(name) for name in (_PARTITIONS, _ADVISORY, _PLANNED, _SEEN, _LISTED, _LISTERS)})
        _asked.append(mine)
        for name, value in wish().items():
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            _asked.remove(mine)
            for name, value in _before.items() if not _asked else ():
                if spark.conf.get(name) != value:
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def bounded_partitions(spark: SparkSession, rows: int, row_bytes: float, most: int = 50_000) -> Iterator[None]:
    """Jobs started here shuffle ``rows`` rows of about ``row_bytes`` packed bytes to a partition for every ``PARTITION_ROWS`` at least, and
    AQE merges them, or splits what is rebalanced, to ``TASK_ROWS``: packed sizes alone don't bound a task's memory, as rows that
    pack well are many. Several threads may ask: the strictest wish holds until all are done, then what was set before.
    Stricter settings of a session stay."""
    parts, size = min(most, -(-rows // PARTITION_ROWS)), max(2**20, int(row_bytes * TASK_ROWS))

    def wish() -> dict[str, object]:
        stricter = {_PARTITIONS: parts} if parts > int(spark.conf.get(_PARTITIONS)) else {}
        return {**stricter, _ADVISORY: size} if size < _size(spark.conf.get(_ADVISORY)) else stricter

    with _held(spark, wish):
        yield


@contextmanager
def bounded_merges(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs started here merge shuffled partitions, or split what is rebalanced, to about ``size`` bytes. Stricter settings stay."""
    with _held(spark, lambda: {_ADVISORY: size} if size < _size(spark.conf.get(_ADVISORY)) else {}):
        yield


@contextmanager
def shared_listing(spark: SparkSession) -> Iterator[None]:
    """Frames made here list their paths in tasks, a few for each core: Spark lists up to 32 paths one by one, however many files lie
    in them, and more with a task for each path."""
    with _held(spark, lambda: {_LISTED: 1, _LISTERS: 4 * spark.sparkContext.defaultParallelism}):
        yield


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs started here broadcast the sides of joins that are marked for it and those that AQE has seen to be small. Spark by itself plans
    by the packed bytes of files, and few of those may hold many millions of rows, which every task would then keep."""

    def wish() -> dict[str, object]:
        seen = spark.conf.get(_SEEN)
        return {_SEEN: spark.conf.get(_PLANNED) if seen is None else seen, _PLANNED: -1}

    with _held(spark, wish):
        yield


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a folder below the warehouse, which they
    share too, where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base.rstrip("/") if base else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder name for one run; nothing is reused or cleared."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
