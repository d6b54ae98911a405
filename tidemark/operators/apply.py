"""Apply a delta to a target: append, upsert, history, replace, reconcile.

Each function returns the new target as a lazy DataFrame; nothing is written here.
Keys compare with plain equality, so null keys never match: such delta rows are all
inserted, each time, and such target rows count as gone when reconciled.

Scale notes. A delta is reduced to one row per key by a ranked window that Spark
limits on the map side, so a hot key sends one row per map task. Target rows meet
only the delta's key columns; AQE broadcasts them when they turn out small and
sorts both sides otherwise. A caller that has measured the delta's keys may pass
``small`` to broadcast them, which leaves target rows where they were read. Rows without
a key match nothing and are salted, so each input is read once and they don't meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fingerprint import comparable
from tidemark.operators.shape import AUDIT_SCHEMA, HISTORY_SCHEMA, business_columns, with_audit, with_history

SALT = "_salt"


def dedupe_latest(
    delta: DataFrame, keys: Sequence[str], watermark: str | None = None, then: Sequence[str] = ()
) -> DataFrame:
    """One row per key: newest watermark first, nulls last, then ``then``, then all
    other business columns so that ties have one answer."""
    order = [F.col(watermark).desc_nulls_last()] if watermark else []
    order += [F.col(c).desc_nulls_last() for c in then]
    used = {*keys, watermark, *then}
    order += [comparable(delta.schema[c]).desc_nulls_last() for c in business_columns(delta) if c not in used]
    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))
    return delta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_rows(
    delta: DataFrame, keys: Sequence[str], watermark: str | None = None, then: Sequence[str] = ()
) -> DataFrame:
    """One row per key, and every row without a key: nothing says those are the same. Such rows get a
    number each as a further key, so one pass serves both and they don't meet in one task."""
    own = F.when(any_null(keys), F.monotonically_increasing_id())
    return dedupe_latest(delta.withColumn(SALT, own), [*keys, SALT], watermark, then).drop(SALT)


def any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def no_nulls(keys: Sequence[str]) -> Column:
    """As plain ``IS NOT NULL`` terms, which the scan can use."""
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def key_set(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct whole keys. Tasks reduce repeats before the shuffle the join needs
    anyway, so a hot key costs one row per task."""
    return rows.where(no_nulls(keys)).select(*keys).distinct()


def _side(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def without_keys(rows: DataFrame, keys: Sequence[str], other: DataFrame, small: bool = False) -> DataFrame:
    """Rows whose key is not in ``other``. Null keys never are; they are salted, so they cannot pile
    up in one task, and ``rows`` are read once."""
    return _salted(rows, keys).join(_side(_unsalted(key_set(other, keys)), small), [*keys, SALT], "left_anti").drop(SALT)


def _salted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spreads rows without a key, which match nothing, over many join partitions."""
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int") + 1
    return rows.withColumn(SALT, F.when(any_null(keys), spread).otherwise(0))


def _unsalted(rows: DataFrame) -> DataFrame:
    return rows.withColumn(SALT, F.lit(0))


def _columns(target: DataFrame, rows: DataFrame) -> list[str]:
    have = set(target.columns)
    extra = [c for c in business_columns(rows) if c not in have]
    own = business_columns(target) + extra
    return own + [c for c in target.columns if c.startswith("_")]


def append(target: DataFrame, delta: DataFrame, batch_ts: Column, batch_id: str) -> DataFrame:
    new = with_audit(delta, batch_ts, batch_id)
    return target.unionByName(new, allowMissingColumns=True).select(*_columns(target, new))


def upsert(
    target: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    batch_ts: Column,
    batch_id: str,
    watermark: str | None = None,
    keep_missing: bool = False,
    small: bool = False,
) -> DataFrame:
    """Matched keys take the delta's values and come back to life; the rest is inserted.

    Without keys the delta is appended. ``keep_missing`` carries the old values of
    columns the delta lacks; otherwise they become null."""
    if not keys:
        return append(target, delta, batch_ts, batch_id)
    new = with_audit(latest_rows(delta, keys, watermark), batch_ts, batch_id)
    if keep_missing:
        lacking = [c for c in business_columns(target) if c not in delta.columns]
        if lacking:
            # rows without a key have no old values and would all meet in one task
            old = target.where(no_nulls(keys)).select(*keys, *lacking)
            matched = new.where(no_nulls(keys)).join(old, list(keys), "left")
            new = matched.unionByName(new.where(any_null(keys)), allowMissingColumns=True)
    return _put(target, new, delta, keys, small)


def _put(
    target: DataFrame, new: DataFrame, delta: DataFrame, keys: Sequence[str], small: bool = False
) -> DataFrame:
    """Target rows the delta does not name, and the new rows. The keys come from the raw
    delta, so ranking it and joining on it are independent."""
    kept = without_keys(target, keys, delta, small)
    return kept.unionByName(new, allowMissingColumns=True).select(*_columns(target, new))


def apply_history(
    target: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    batch_ts: Column,
    batch_id: str,
    watermark: str | None = None,
    only_changed: bool = False,
    small: bool = False,
) -> DataFrame:
    """Close the current version of every delta key and add the delta as current.

    Closed versions and null keys pass through without a join. ``only_changed`` leaves alone the
    keys whose business values equal the current version."""
    if not keys:
        raise ValueError("a history target needs a key")
    new = latest_rows(delta, keys, watermark)
    is_current = F.coalesce(F.col("_is_current"), F.lit(False))
    joinable = is_current & ~any_null(keys)
    current, closed = target.where(joinable), target.where(~joinable)
    if only_changed:
        values = [c for c in business_columns(target) if c in delta.columns and c not in keys]
        same = [F.col(f"n.{k}") == F.col(f"c.{k}") for k in keys]
        same += [F.col(f"n.{v}").eqNullSafe(F.col(f"c.{v}")) for v in values]
        keyed = new.where(no_nulls(keys)).alias("n").join(current.alias("c"), reduce(and_, same), "left_anti")
        new = keyed.unionByName(new.where(any_null(keys)))
    hit = key_set(new if only_changed else delta, keys).withColumn("_hit", F.lit(True))
    matched = F.coalesce(F.col("_hit"), F.lit(False))
    changed = {
        "_valid_to": F.when(matched, batch_ts.cast("timestamp_ntz")).otherwise(F.col("_valid_to")),
        "_is_current": F.when(matched, F.lit(False)).otherwise(F.col("_is_current")),
        "_load_ts": F.when(matched, batch_ts.cast("timestamp_ntz")).otherwise(F.col("_load_ts")),
        "_batch_id": F.when(matched, F.lit(batch_id)).otherwise(F.col("_batch_id")),
    }
    rewritten = current.join(_side(hit, small), list(keys), "left").withColumns(changed).drop("_hit")
    versions = with_history(with_audit(new, batch_ts, batch_id), batch_ts)
    names = _columns(target, versions)
    return (
        closed.unionByName(rewritten.select(*target.columns))
        .unionByName(versions, allowMissingColumns=True)
        .select(*names)
    )


def replace_all(target: DataFrame, rows: DataFrame, batch_ts: Column, batch_id: str) -> DataFrame:
    """The extract alone, in the target's columns."""
    return append(target.limit(0), rows, batch_ts, batch_id)


def replace_where(
    target: DataFrame, predicate: str, extract: DataFrame, batch_ts: Column, batch_id: str
) -> DataFrame:
    """Target rows that meet the predicate give way to the extract."""
    kept = target.where(~F.coalesce(F.expr(predicate), F.lit(False)))
    return append(kept, extract, batch_ts, batch_id)


def replace_where_history(
    target: DataFrame,
    predicate: str,
    extract: DataFrame,
    keys: Sequence[str],
    batch_ts: Column,
    batch_id: str,
    watermark: str | None = None,
    small: bool = False,
) -> DataFrame:
    """``replace_where`` for a history: current versions that meet the predicate and whose key the extract lacks are closed;
    keys with other values get a new version, equal ones keep theirs. Versions without a key match nothing: those
    that meet the predicate are closed, and the extract's are opened."""
    current = F.coalesce(F.col("_is_current"), F.lit(False)) & F.coalesce(F.expr(predicate), F.lit(False))
    met, rest = target.where(current), target.where(~current)
    named = key_set(extract, keys).withColumn("_named", F.lit(True))
    marked = _salted(met, keys).join(_side(_unsalted(named), small), [*keys, SALT], "left").drop(SALT)
    stamp = batch_ts.cast("timestamp_ntz")
    gone = marked.where("_named IS NULL").withColumns({"_valid_to": stamp, "_is_current": F.lit(False), "_load_ts": stamp, "_batch_id": F.lit(batch_id)})
    still = rest.unionByName(gone.select(*target.columns)).unionByName(marked.where("_named").select(*target.columns))
    return apply_history(still, extract, keys, batch_ts, batch_id, watermark, True, small)


def gone_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live target keys the source no longer has. Only key columns are read and moved."""
    live = target.where(~F.coalesce(F.col("_is_deleted"), F.lit(False))).select(*keys)
    return without_keys(live, keys, source)


def soft_delete(
    target: DataFrame, gone: DataFrame, keys: Sequence[str], batch_ts: Column, small: bool = False
) -> DataFrame:
    """Flag live rows whose key is in ``gone`` or null."""
    live = ~F.coalesce(F.col("_is_deleted"), F.lit(False))
    if "_is_current" in target.columns:
        live = live & F.coalesce(F.col("_is_current"), F.lit(False))

    def flag(rows: DataFrame, hit: Column) -> DataFrame:
        return rows.withColumns(
            {
                "_is_deleted": F.when(hit, F.lit(True)).otherwise(F.col("_is_deleted")),
                "_deleted_at": F.when(hit, batch_ts.cast("timestamp_ntz")).otherwise(F.col("_deleted_at")),
            }
        ).select(*target.columns)

    marked = _unsalted(key_set(gone, keys)).withColumn("_gone", F.lit(True))
    joined = _salted(target, keys).join(_side(marked, small), [*keys, SALT], "left")
    return flag(joined, live & (F.coalesce(F.col("_gone"), F.lit(False)) | any_null(keys)))


def reconcile(target: DataFrame, source: DataFrame, keys: Sequence[str], batch_ts: Column) -> DataFrame:
    """Soft-delete live rows whose key is gone from the source.

    The key sets are compared first, with keys only; wide target rows then meet just
    the gone keys, usually few. Null keys are gone by definition and need no join."""
    return soft_delete(target, gone_keys(target.where(no_nulls(keys)), source, keys), keys, batch_ts)


def apply_backlog_upsert(
    target: DataFrame,
    backlog: DataFrame,
    keys: Sequence[str],
    batch: str,
    batch_ts: Column,
    batch_id: str,
    watermark: str | None = None,
) -> DataFrame:
    """Many waiting batches as one upsert, with the result of applying them in order.

    In order means the last batch that has a key wins; inside a batch the newest
    watermark does. One pass replaces a loop over files."""
    order = [watermark] if watermark else []
    latest = latest_rows(backlog, keys, batch, order).drop(batch)
    return _put(target, with_audit(latest, batch_ts, batch_id), backlog, keys)


def apply_backlog_history(
    target: DataFrame,
    backlog: DataFrame,
    keys: Sequence[str],
    batch: str,
    batch_ts: str,
    watermark: str | None = None,
) -> DataFrame:
    """Many waiting batches as history: versions between batches survive, closed.

    ``batch_ts`` names the column with each batch's time. Rows are first cut to one
    per key and batch, so a key's window holds at most one row per waiting batch."""
    per_batch = dedupe_latest(backlog.where(no_nulls(keys)), [*keys, batch], watermark)
    w = Window.partitionBy(*keys).orderBy(batch)
    keyed = per_batch.withColumns({"_next": F.lead(batch_ts).over(w), "_next_batch": F.lead(batch).over(w)})
    loose = backlog.where(any_null(keys)).withColumns(
        {n: F.lit(None).cast(backlog.schema[c].dataType) for n, c in (("_next", batch_ts), ("_next_batch", batch))}
    )
    chain = keyed.unionByName(loose).withColumns(
        {
            "_load_ts": F.coalesce("_next", batch_ts),
            "_src_file": F.lit(None).cast("string"),
            "_batch_id": F.coalesce("_next_batch", batch).cast("string"),
            "_is_deleted": F.lit(False),
            "_deleted_at": F.lit(None).cast("timestamp_ntz"),
            "_valid_from": F.col(batch_ts),
            "_valid_to": F.col("_next"),
            "_is_current": F.col("_next").isNull(),
        }
    )
    versions = chain.select(
        *[c for c in business_columns(backlog) if c not in (batch, batch_ts)], *AUDIT_SCHEMA, *HISTORY_SCHEMA
    )
    first = (
        backlog.where(no_nulls(keys))
        .groupBy(*keys)
        .agg(F.min(F.struct(batch, batch_ts)).alias("_first"))
    )
    hit = F.col("_first").isNotNull()
    joinable = F.coalesce(F.col("_is_current"), F.lit(False)) & ~any_null(keys)
    current = target.where(joinable).join(first, list(keys), "left").withColumns(
        {
            "_valid_to": F.when(hit, F.col(f"_first.{batch_ts}")).otherwise(F.col("_valid_to")),
            "_load_ts": F.when(hit, F.col(f"_first.{batch_ts}")).otherwise(F.col("_load_ts")),
            "_batch_id": F.when(hit, F.col(f"_first.{batch}").cast("string")).otherwise(F.col("_batch_id")),
            "_is_current": ~hit,
        }
    )
    closed = target.where(~joinable)
    return closed.unionByName(current.select(*target.columns)).unionByName(versions, allowMissingColumns=True)


def merge_statement(target: str, source: str, keys: Sequence[str], columns: Sequence[str], batch_id: str) -> str:
    """``MERGE INTO`` text for catalogs whose tables support it. ``source`` holds one row
    per key with a ``_load_ts``."""
    on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
    plain = [c for c in columns if not c.startswith("_")]
    sets = ", ".join(f"t.`{c}` = s.`{c}`" for c in plain)
    names = ", ".join(f"`{c}`" for c in [*plain, "_load_ts", "_batch_id", "_is_deleted"])
    values = ", ".join([*(f"s.`{c}`" for c in plain), "s._load_ts", f"'{batch_id}'", "false"])
    return (
        f"MERGE INTO {target} t USING {source} s ON {on} "
        f"WHEN MATCHED THEN UPDATE SET {sets}, t._load_ts = s._load_ts, t._batch_id = '{batch_id}', "
        f"t._is_deleted = false, t._deleted_at = NULL "
        f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )
