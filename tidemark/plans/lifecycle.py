"""One table's run from plan to log row: scan, apply, record; reconcile; validate; backlog.

A table's state is a small file that names its folder, and in that folder the table's own version
file, which holds the cursor with the data it belongs to: both move in one step. The run log only
reports. A run that dies before that step changes nothing; one that dies after it is
logged by the table's next run.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.values import ntz, time_ceiling
from tidemark.operators import apply, manifest, parity, shape
from tidemark.plans import gaps
from tidemark.sinks import storage
from tidemark.sinks.logfolder import LogFolder
from tidemark.sinks.tables import KeyedTable, bucket_count
from tidemark.sources.scan import Scan, cursor_literal, cursor_value, scan, with_lookback

LOG_SCHEMA = (
    "batch_id string, config_id string, load_type string, status string, rows_extracted bigint, "
    "rows_loaded bigint, watermark_from string, watermark_to string, location string, "
    "error_message string, run_start timestamp_ntz, run_end timestamp_ntz, inserted_at timestamp_ntz, "
    "null_cursors bigint, schema_changes string"
)
FILE_SCHEMA = (
    "file_name string, file_size_bytes bigint, row_count bigint, run_id string, extracted_at timestamp_ntz, "
    "uploaded_at timestamp_ntz, loaded_at timestamp_ntz, status string, config_id string, run_at timestamp_ntz, "
    "manifest_id string, folder string, step bigint"
)
#: Buckets of a new table whose size its source does not tell.
DEFAULT_BUCKETS = 64


@dataclass(frozen=True)
class Table:
    """One configured table.

    ``load_type``: ``incremental``; ``full`` and ``sql`` replace the table by what the source
    gives, be it nothing (``sql`` says that this is a query's result); ``filter`` replaces the target rows that meet
    ``filter`` by the source rows that do, and leaves the cursor where it is. In a history, versions that meet the filter and are gone
    or changed are closed. ``change_columns`` are read as one window: a row is taken if any of
    them lies in it. ``lookback_minutes`` reads again what came shortly before the cursor, for late rows. ``only_changed`` adds
    history versions only for values that differ; ``keep_missing`` keeps old values of columns that
    the source has no more. ``gap_minutes`` is how long ids that were skipped below an id
    cursor are looked for, for rows whose transaction ends late (a first load watches from its smallest id on). ``buckets`` is for a new table; without it its size decides."""

    config_id: str
    keys: tuple[str, ...] = ()
    load_type: str = "incremental"
    scd_type: int = 1
    cursor_column: str | None = None
    cursor_type: str = "time"
    filter: str | None = None
    lag_minutes: int = 1
    buckets: int | None = None
    active: bool = True
    change_columns: tuple[str, ...] = ()
    lookback_minutes: int = 0
    only_changed: bool = False
    keep_missing: bool = False
    gap_minutes: int = 0


@dataclass(frozen=True)
class Run:
    """What all tables of one batch share. ``root`` lies in shared storage.

    ``ceilings`` give greatest ids and ``measures`` row counts and greatest cursors (as text), where
    a source tells them without a scan."""

    spark: SparkSession
    root: str
    batch_id: str
    as_of: datetime
    sources: Mapping[str, Callable[[], DataFrame]] = field(default_factory=dict)
    ceilings: Mapping[str, Callable[[], object]] = field(default_factory=dict)
    after_load: str = "archive"  # what becomes of loaded extracts: archive, purge, keep
    measures: Mapping[str, Callable[[], tuple[int, str | None]]] = field(default_factory=dict)
    log: bool = True  # run_all writes the log itself, once

    @property
    def log_path(self) -> str:
        return f"{self.root}/run_log"


def _logged(run: Run) -> LogFolder:
    return LogFolder(run.spark, run.log_path, T.StructType.fromDDL(LOG_SCHEMA))


def run_log(run: Run) -> DataFrame | None:
    """All records. Each write has a folder of its own, so writers never share one; many are merged into few."""
    return _logged(run).read()


def _newest(run: Run, folder: str) -> tuple[int, dict]:
    """The last of a folder's numbered small files."""
    names = [n for n in storage.children(run.spark, folder) if n.endswith(".json")]
    if not names:
        return 0, {}
    return int(names[-1].removesuffix(".json")), json.loads(storage.read_text(run.spark, f"{folder}/{names[-1]}"))


def _move_to(run: Run, folder: str, number: int, state: dict) -> None:
    if not storage.publish_text(run.spark, f"{folder}/{number:012d}.json", json.dumps(state)):
        raise RuntimeError(f"another run of {folder} was faster")


def _pointer(run: Run, table: Table) -> str:
    return f"{run.root}/tables/{table.config_id}/at"


def last_state(run: Run, table: Table) -> tuple[str | None, str | None]:
    """Cursor and data folder of the newest load."""
    location = _newest(run, _pointer(run, table))[1].get("location")
    if location is None:
        return None, None
    return stored(run, table, location).version().note.get("cursor"), location


def stored(run: Run, table: Table, location: str, buckets: int | None = None) -> KeyedTable:
    """Closed versions of a history table are settled: written once, never again."""
    settled = "NOT _is_current" if table.scd_type == 2 else None
    return KeyedTable(run.spark, location, table.keys, buckets or table.buckets or DEFAULT_BUCKETS, settled)


def _token(run: Run, *parts: object) -> str:
    """A batch's window: the same batch may read several, each is loaded once."""
    return hashlib.sha256("\0".join(map(str, (run.batch_id, *parts))).encode()).hexdigest()[:16]


def sync(run: Run, table: Table, force_full: bool = False) -> dict:
    """Load one table. Without a stored cursor the load is full: every row that the table's filter
    lets through, whatever its cursor. An empty window is skipped and leaves the cursor alone; a full load of an
    emptied source empties its table.

    An increment reads ``(cursor, ceiling]``, so rows without a cursor come with full loads only; its
    record counts them. In a full load rows past the ceiling come too and are read again by the next
    increment, which an upsert absorbs; append-only tables leave them to it. The source is read
    once, into files; counts and the new cursor come from those, so a repeated task cannot count twice."""
    lost = _unlogged(run, table)
    if lost:
        _append(replace(run, log=True), lost)
    cursor, location = last_state(run, table)
    whole = table.load_type in ("full", "sql")
    full = force_full or whole or location is None or (cursor is None and table.load_type != "filter")
    kind = "full" if full else table.load_type
    record = _record(run, table, kind, watermark_from=cursor, location=location)
    try:
        ceiling = _ceiling(run, table)
        source = run.sources[table.config_id]()
        if table.load_type == "filter" and not table.filter:
            raise ValueError("a filter load needs a filter")
        rows = _window(source, table, kind, cursor, ceiling)
        if _watches(table) and kind == "incremental" and location:
            spans = _spans(run, stored(run, table, location).version().note)
            late = scan(source, Scan(filter=table.filter))
            rows = rows if spans is None else rows.unionByName(gaps.late_rows(late, cursor_value(late, table.cursor_column, "id"), spans, int(cursor)))
        if not full and table.cursor_column and kind == "incremental":
            record["null_cursors"] = source.where(F.col(table.cursor_column).isNull()).count()
        if location:
            record["schema_changes"] = shape.schema_changes(stored(run, table, location).version().schema, rows.schema)
        if full and not (table.scd_type == 2 and location):
            _load_whole(run, table, rows, ceiling, record)
        else:
            _load_part(run, table, rows, ceiling, record)
    except Exception as error:  # the row of a failed run is what monitoring reads
        record.update(status="failed", error_message=str(error), location=location, watermark_to=cursor)
    _append(run, record)
    if record["status"] in ("success", "skipped"):
        _put_away(run, table, record["load_type"])
    return record


def _window(source: DataFrame, table: Table, kind: str, cursor: str | None, ceiling: object) -> DataFrame:
    if kind != "incremental":
        rows = scan(source, Scan("FILTER" if kind == "filter" else "FULL", filter=table.filter))
        if table.scd_type == 0 and table.cursor_column and ceiling is not None and kind == "full":
            value = cursor_value(source, table.cursor_column, table.cursor_type)
            rows = rows.where(value.isNull() | (value <= cursor_literal(source, table.cursor_column, table.cursor_type, ceiling)))
        return rows
    if table.lookback_minutes and table.scd_type == 0:
        raise ValueError("reading a window again needs an upsert or a history")
    if table.lookback_minutes:
        return with_lookback(scan(source, Scan(filter=table.filter)), table.cursor_column, cursor, table.lookback_minutes, ceiling)
    spec = Scan(
        "INCREMENTAL" if table.cursor_column or table.change_columns else "FULL", filter=table.filter,
        cursor_column=table.cursor_column, cursor_type=table.cursor_type, change_columns=table.change_columns,
    )
    return scan(source, spec, cursor, ceiling)


def _watches(table: Table) -> bool:
    return bool(table.gap_minutes and table.cursor_type == "id" and table.cursor_column)


def _spans(run: Run, note: Mapping) -> DataFrame | None:
    """The ids that a load's note says are missing."""
    return run.spark.read.schema(gaps.SPANS).parquet(note["gaps"]) if note.get("gaps") else None


def _missed(run: Run, table: Table, written: DataFrame, place: str, cursor: str | None, before: str | None, known: DataFrame | None) -> dict:
    """The next ledger of missing ids, stored, as a part of a load's note."""
    if not _watches(table) or cursor is None:
        return {}
    ids = written.select(cursor_value(written, table.cursor_column, "id").cast("long").alias("id"))
    low = int(before) if before is not None else ids.agg(F.min("id")).first()[0] - 1
    path = f"{place}/gaps/{uuid.uuid4().hex[:12]}"
    gaps.ledger(ids, known, low, int(cursor), run.as_of, table.gap_minutes).write.parquet(path)
    return {"gaps": path}


def _extract_path(run: Run, table: Table) -> str:
    return f"{run.root}/extracts/{table.config_id}/{run.batch_id}"


def _put_away(run: Run, table: Table, kind: str) -> None:
    """Archive or remove a batch's loaded extracts, once their log row is written."""
    path = _extract_path(run, table)
    if run.after_load == "keep" or not storage.exists(run.spark, path):
        return
    if run.after_load == "archive":
        for name in storage.children(run.spark, path):
            place = storage.archive_path(run.root, kind, f"{run.as_of:%Y%m%d}", f"{table.config_id}/{run.batch_id}/{name}")
            storage.move(run.spark, f"{path}/{name}", place)
    storage.purge(run.spark, path)


def _extract(run: Run, table: Table, rows: DataFrame) -> DataFrame:
    """The window's rows as files of their own, so a retry never mixes with what died."""
    path = f"{_extract_path(run, table)}/{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return run.spark.read.schema(rows.schema).parquet(path)


def _measure(written: DataFrame, table: Table, ceiling: object) -> Row:
    """Rows, and the cursor they lead to: never past the ceiling. A filter load leads to none, since it
    leaves rows out that lie before it."""
    if table.load_type == "filter":
        newest = F.lit(None).cast("string")
    elif table.change_columns:
        newest = F.lit(None if ceiling is None else str(ceiling))
    elif table.cursor_column:
        value = cursor_value(written, table.cursor_column, table.cursor_type)
        limit = cursor_literal(written, table.cursor_column, table.cursor_type, ceiling)
        newest = F.max(value if ceiling is None else F.when(value <= limit, value)).cast("string")
    else:
        newest = F.lit(None).cast("string")
    return written.agg(F.count(F.lit(1)).alias("n"), newest.alias("cursor")).first()


def _ceiling(run: Run, table: Table) -> object | None:
    """Fixed before the read, so rows that arrive meanwhile come with the next run."""
    if table.change_columns:
        return time_ceiling(run.as_of, table.lag_minutes)
    if not table.cursor_column:
        return None
    if table.cursor_type == "id" and table.config_id in run.ceilings:
        return run.ceilings[table.config_id]()
    if table.cursor_type == "id":
        source = run.sources[table.config_id]()
        return source.agg(F.max(cursor_value(source, table.cursor_column, table.cursor_type))).first()[0]
    return time_ceiling(run.as_of, table.lag_minutes)


def _note(run: Run, record: dict, token: str, rows: int, cursor: str | None) -> dict:
    """What the table itself remembers of its last load: enough for the log row."""
    return {"cursor": cursor, "token": token, "batch_id": run.batch_id, "load_type": record["load_type"], "rows": rows,
            "watermark_from": record["watermark_from"], "as_of": run.as_of.isoformat()}


def _load_whole(run: Run, table: Table, rows: DataFrame, ceiling: object, record: dict) -> None:
    """A new folder; readers move to it when it is whole. The folder before the last is removed. The rows as they were
    written are counted before the first version is committed, which has the note already."""
    batch_ts, base = ntz(run.as_of), f"{run.root}/tables/{table.config_id}"
    fresh = f"{base}/{run.batch_id}-{uuid.uuid4().hex[:8]}"
    new = shape.with_audit(rows, batch_ts, run.batch_id)
    target, seen = stored(run, table, fresh, table.buckets or _sized(rows)), []

    def told(written: DataFrame) -> dict | None:
        """Nothing is made of a source that has no rows yet; a table whose source was emptied is emptied too."""
        seen.append(_measure(written, table, ceiling))
        n, cursor = seen[0]
        if n == 0 and record["location"] is None:
            return None
        return {**_note(run, record, _token(run, fresh), n, cursor), **_missed(run, table, written, fresh, cursor, None, None)}

    if not target.create(shape.with_history(new, batch_ts) if table.scd_type == 2 else new, told, append_only=table.scd_type == 0):
        storage.purge(run.spark, fresh)
        record.update(rows_extracted=0, status="skipped", watermark_to=record["watermark_from"])
        return
    number, before = _newest(run, _pointer(run, table))
    _move_to(run, _pointer(run, table), number + 1, {"location": fresh, "before": before.get("location")})
    if before.get("before"):
        storage.purge(run.spark, before["before"])
    record.update(rows_extracted=seen[0].n, rows_loaded=seen[0].n, status="success", watermark_to=seen[0].cursor, location=fresh)


def _sized(rows: DataFrame) -> int:
    """Buckets by the size Spark's plan knows of the source; a source that cannot tell gets the default."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return DEFAULT_BUCKETS if size >= 1 << 60 else max(8, bucket_count(size))


def _load_part(run: Run, table: Table, rows: DataFrame, ceiling: object, record: dict) -> None:
    written = _extract(run, table, rows)
    seen = _measure(written, table, ceiling)
    record["rows_extracted"] = seen.n
    cursor = seen.cursor or record["watermark_from"]
    if seen.n == 0 and record["load_type"] != "filter":
        record.update(status="skipped", watermark_to=record["watermark_from"])
        return
    if table.lookback_minutes and record["watermark_from"] is not None and table.cursor_type == "time":
        cursor = max(cursor, record["watermark_from"])
    old = stored(run, table, record["location"]).version().note
    if _watches(table) and record["watermark_from"] is not None:
        cursor = str(max(int(cursor), int(record["watermark_from"])))  # late ids lie below
    token = _token(run, record["load_type"], record["watermark_from"], ceiling, uuid.uuid4())
    note = {**({"gaps": old["gaps"]} if old.get("gaps") else {}), **_note(run, record, token, seen.n, cursor)}
    if record["load_type"] == "incremental":
        note.update(_missed(run, table, written, record["location"], cursor, record["watermark_from"], _spans(run, old)))
    _load_delta(run, table, written, record, token, note)
    record.update(status="success", rows_loaded=seen.n, watermark_to=cursor)


def _load_delta(run: Run, table: Table, delta: DataFrame, record: dict, token: str, note: dict) -> None:
    batch_ts, target = ntz(run.as_of), stored(run, table, record["location"])
    if record["load_type"] == "filter" and table.scd_type == 2:
        target.apply(
            delta,
            lambda t, d, small: apply.replace_where_history(shape.widen(t, d), table.filter, d, table.keys, batch_ts, run.batch_id, table.cursor_column, small),
            token, with_no_key=True, note=note, also=f"({table.filter}) AND _is_current",
        )
        return
    if record["load_type"] == "filter":
        target.apply(
            delta, lambda t, d, small: apply.replace_where(shape.widen(t, d), table.filter, d, batch_ts, run.batch_id),
            token, note=note, also=table.filter, matching=False,
        )
        return
    if table.scd_type == 0 or not table.keys:
        target.add(shape.with_audit(delta, batch_ts, run.batch_id), token, note=note)
        return
    if table.scd_type == 2:
        # rows of a window that is read again are no new versions of themselves
        change, options = apply.apply_history, {"only_changed": table.only_changed or table.lookback_minutes > 0}
    else:
        change, options = apply.upsert, {"keep_missing": table.keep_missing}
    target.apply(
        delta,
        lambda t, d, small: change(shape.widen(t, d), d, table.keys, batch_ts, run.batch_id, table.cursor_column, small=small, **options),
        token,
        note=note,
    )


def reconcile(run: Run, table: Table) -> dict:
    """Soft-delete target rows whose key left the source; only files with gone keys
    are rewritten. Digests of both sides say in which buckets keys differ, and only keys of those buckets are moved. Tables that are
    only appended to have no buckets, so all their keys are compared; their files are rewritten if they hold a gone key."""
    _, location = last_state(run, table)
    record = _record(run, table, "reconcile", location=location)
    if location is None or not table.keys:
        record.update(status="skipped")
        return _append(run, record)
    target, source = stored(run, table, location), run.sources[table.config_id]()
    if table.filter:
        source = source.where(F.expr(table.filter))
    if table.scd_type == 0:
        current = target.read()
    else:
        buckets, source = target.differing(source)
        current = target.read_buckets(buckets)
    gone = apply.gone_keys(current, source, table.keys)
    path = f"{location}/gone/{uuid.uuid4().hex[:12]}"
    gone.write.parquet(path)
    kept = run.spark.read.schema(gone.schema).parquet(path)
    deleted = kept.count()
    if deleted:
        batch_ts = ntz(run.as_of)
        target.apply(
            kept,
            lambda t, d, small: apply.soft_delete(t, d, table.keys, batch_ts, small),
            _token(run, "reconcile", path),
            with_no_key=not kept.where(apply.any_null(table.keys)).isEmpty(),
            also="true" if table.scd_type == 0 else None,
        )
    storage.purge(run.spark, path)
    record.update(status="success", rows_loaded=deleted)
    return _append(run, record)


def validate(run: Run, table: Table, deep: bool = False) -> dict:
    """Compare source and live target, both under the table's filter: count, watermark and, on request, the
    rows themselves. A column that only the source has fails a deep check; both lists are reported."""
    _, location = last_state(run, table)
    record = _record(run, table, "validate", location=location)
    if location is None:
        record.update(status="skipped")
        return _append(run, record)
    source, target = run.sources[table.config_id](), stored(run, table, location).read()
    if table.filter:
        source, target = source.where(F.expr(table.filter)), target.where(F.expr(table.filter))
    columns = [c for c in source.columns if c in target.columns]
    lacking = [c for c in source.columns if c not in target.columns]
    extra = [c for c in shape.business_columns(target) if c not in source.columns]
    known = None if deep else run.measures.get(table.config_id)
    row = parity.parity(source, target, columns, table.cursor_column, deep, exact=deep, known=known and known(), fixed=False).first()
    ok = row.ok and not (deep and lacking)
    told = [] if row.ok else [f"count_ok={row.count_ok} wm_ok={row.wm_ok}" + (f" sum_ok={row.sum_ok}" if deep else "")]
    told += [f"only in source: {', '.join(lacking)}"] * bool(lacking) + [f"only in target: {', '.join(extra)}"] * bool(extra)
    record.update(
        status="success" if ok else "mismatch",
        rows_extracted=row.source_rows,
        rows_loaded=row.target_rows,
        watermark_from=row.source_wm,
        watermark_to=row.target_wm,
        error_message="; ".join(told) or None,
    )
    return _append(run, record)


def vacuum(run: Run, table: Table) -> dict:
    """Merge a table's small appended files and remove what no version names: files of dead writes, and folders of loads that came to
    nothing. No other run of the table may be at work. The record's loaded rows are the files and folders removed."""
    _, location = last_state(run, table)
    record = _record(run, table, "vacuum", location=location)
    if location is None:
        record.update(status="skipped")
        return _append(run, record)
    target, base = stored(run, table, location), f"{run.root}/tables/{table.config_id}"
    target.compact()
    kept = {location.rsplit("/", 1)[1], str(_newest(run, _pointer(run, table))[1].get("before")).rsplit("/", 1)[-1], "at"}
    gone = target.vacuum() + sum(storage.purge(run.spark, f"{base}/{n}") for n in storage.children(run.spark, base) if n not in kept)
    record.update(status="success", rows_loaded=gone)
    return _append(run, record)


def run_all(run: Run, tables: Iterable[Table], step: Callable[[Run, Table], dict] = sync, at_once: int = 4) -> list[dict]:
    """The same step for every active table; Spark shares its executors between them. Their records
    are written at once, at the end."""
    quiet = replace(run, log=False)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        records = list(pool.map(lambda t: step(quiet, t), [t for t in tables if t.active]))
    _write_log(run, records)
    return records


def _record(run: Run, table: Table, load_type: str, **known: object) -> dict:
    empty = dict.fromkeys(c.split()[0] for c in LOG_SCHEMA.split(", "))
    return {
        **empty, "batch_id": run.batch_id, "config_id": table.config_id, "load_type": load_type,
        "run_start": _now(), "inserted_at": run.as_of, **known,
    }


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _append(run: Run, record: dict) -> dict:
    record["run_end"] = _now()
    if run.log:
        _write_log(run, [record])
    return record


def _write_log(run: Run, records: list[dict]) -> None:
    """One folder per write. Then each table's folder is marked: its last load is in the log."""
    if not records:
        return
    _logged(run).append(run.spark.createDataFrame(records, LOG_SCHEMA))
    for r in records:
        if r["status"] == "success" and r["load_type"] not in ("reconcile", "validate", "vacuum") and r["location"]:
            note = KeyedTable(run.spark, r["location"], ()).version().note
            if note.get("token"):
                storage.publish_text(run.spark, f"{r['location']}/logged/{note['token']}", "")


def _unlogged(run: Run, table: Table) -> dict | None:
    """The log row of a load that was committed by a run that died before it logged it."""
    _, location = last_state(run, table)
    note = stored(run, table, location).version().note if location else {}
    if not note.get("token") or storage.exists(run.spark, f"{location}/logged/{note['token']}"):
        return None
    return _record(
        replace(run, batch_id=note["batch_id"], as_of=datetime.fromisoformat(note["as_of"])), table, note["load_type"], status="success",
        rows_extracted=note["rows"], rows_loaded=note["rows"], watermark_from=note["watermark_from"], watermark_to=note["cursor"], location=location,
    )


def _extracted(run: Run, table: Table) -> str:
    return f"{run.root}/backlog/{table.config_id}/at"


def _registered(run: Run) -> LogFolder:
    return LogFolder(run.spark, f"{run.root}/files", T.StructType.fromDDL(FILE_SCHEMA))


def files(run: Run) -> DataFrame | None:
    """The manifest of extracted files, each with its newest status."""
    rows = _registered(run).read()
    if rows is None:
        return None
    known = rows.where("status = 'extracted'")
    changes = rows.where("status <> 'extracted'").select("manifest_id", "status", F.col("loaded_at").alias("changed_at"))
    return manifest.set_status(known, changes)


def _register(run: Run, rows: DataFrame) -> None:
    _registered(run).append(rows)


def extract(run: Run, table: Table) -> dict:
    """Read the next window into files and register them, without loading them. Windows follow each
    other from the table's own cursor; a table must have been loaded in full before."""
    loaded, location = last_state(run, table)
    if location is None or not table.cursor_column:
        raise ValueError(f"{table.config_id} needs a first load and a cursor before a backlog")
    if table.scd_type == 2 and table.lookback_minutes:
        raise ValueError("a backlog adds each row it reads to a history, so it cannot read a window again")
    number, state = _newest(run, _extracted(run, table))
    cursor = max((c for c in (state.get("cursor"), loaded) if c is not None), key=_cursor_order(table), default=None)
    record = _record(run, table, "extract", watermark_from=cursor, location=location)
    ceiling = _ceiling(run, table)
    rows = _window(run.sources[table.config_id](), table, "incremental", cursor, ceiling)
    folder = f"{run.root}/backlog/{table.config_id}/{run.batch_id}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(folder)
    written = run.spark.read.schema(rows.schema).parquet(folder)
    seen = _measure(written, table, ceiling)
    if seen.n == 0:
        record.update(status="skipped", rows_extracted=0, watermark_to=cursor)
        return _append(run, record)
    found = manifest.register(written, run.batch_id, ntz(run.as_of)).withColumns(
        {"config_id": F.lit(table.config_id), "run_at": ntz(run.as_of), "folder": F.lit(folder), "step": F.lit(number + 1).cast("bigint"),
         "manifest_id": F.concat(F.lit(f"{table.config_id}/{run.batch_id}/"), "file_name")}
    )
    _register(run, found)
    _move_to(run, _extracted(run, table), number + 1, {"cursor": seen.cursor, "folder": folder, "batch_id": run.batch_id, "as_of": run.as_of.isoformat()})
    record.update(status="success", rows_extracted=seen.n, watermark_to=seen.cursor)
    return _append(run, record)


def _cursor_order(table: Table) -> Callable[[str], object]:
    return int if table.cursor_type == "id" else str


def load_backlog(run: Run, table: Table) -> dict:
    """Load the registered files that no load has taken yet as if one by one, in the order of their
    extracts, in one pass; then mark them loaded."""
    cursor, location = last_state(run, table)
    record = _record(run, table, "backlog", watermark_from=cursor, location=location)
    number, _ = _newest(run, _extracted(run, table))
    version = stored(run, table, location).version() if location else None
    first = int(version.writers.get("backlog", "0")) + 1 if version else 1
    known = files(run)
    waiting = None if known is None else known.where((F.col("config_id") == table.config_id) & F.col("status").isin(*manifest.PENDING))
    if version and known is not None and first > 1:
        # files of steps that were committed but not marked: a load died between the two
        _mark_loaded(run, waiting.where(F.col("step") < first))
        waiting = waiting.where(F.col("step") >= first)
    steps = [] if waiting is None else [r.step for r in waiting.select("step").distinct().orderBy("step").collect()]
    if not steps:
        record.update(status="skipped", watermark_to=cursor)
        return _append(run, record)
    each = []
    for step in steps:  # one per waiting extract
        state = json.loads(storage.read_text(run.spark, f"{_extracted(run, table)}/{step:012d}.json"))
        rows = run.spark.read.parquet(state["folder"])
        each.append(rows.withColumns({"_step": F.lit(step).cast("bigint"), "_step_ts": ntz(datetime.fromisoformat(state["as_of"]))}))
        last = state
    batch_ts, target = ntz(run.as_of), stored(run, table, location)
    backlog = each[0]
    for rows in each[1:]:
        backlog = backlog.unionByName(rows, allowMissingColumns=True)
    n = backlog.count()

    def change(t: DataFrame, d: DataFrame, small: bool) -> DataFrame:
        t = shape.widen(t, d)
        if table.scd_type == 2:
            return apply.apply_backlog_history(t, d, table.keys, "_step", "_step_ts", table.cursor_column)
        return apply.apply_backlog_upsert(t, d.drop("_step_ts"), table.keys, "_step", batch_ts, run.batch_id, table.cursor_column)

    note = _note(run, record, _token(run, "backlog", steps[-1]), n, last["cursor"])
    if table.scd_type == 0 or not table.keys:
        target.add(shape.with_audit(backlog, batch_ts, run.batch_id), str(steps[-1]), "backlog", note)
    else:
        target.apply(backlog, change, str(steps[-1]), writer="backlog", note=note)
    _mark_loaded(run, waiting)
    record.update(status="success", rows_extracted=n, rows_loaded=n, watermark_to=last["cursor"])
    return _append(run, record)


def _mark_loaded(run: Run, rows: DataFrame) -> None:
    _register(run, rows.withColumns({"status": F.lit("loaded"), "loaded_at": ntz(run.as_of)}))
