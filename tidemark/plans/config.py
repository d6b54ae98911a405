"""Configuration as tables: which jobs run, by which cursor, key and load type.

Every rule is one projection or join over all configured tables at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.apply import key_set

# Column names that can serve as a watermark, best first.
WATERMARK_NAMES = ("updated_at", "modified_at", "last_modified", "updated_on", "created_at", "created_on")
TERADATA_WATERMARK_NAMES = (*WATERMARK_NAMES, "update_ts", "modify_ts")
TIME_TYPES = ("datetime", "timestamp", "date")
TERADATA_TIME_CODES = ("TS", "SZ", "DA", "AT")
ID_TYPES = ("int", "integer", "bigint", "smallint", "mediumint", "tinyint")
FULL_PARALLEL = 8
NO_KEY_NOTE = "no primary key — full load only"
COMPOSITE_NOTE = "composite key"
NO_WATERMARK_NOTE = "no watermark column detected"
TERADATA_NO_KEY_NOTE = "no primary index — full load only"
TERADATA_COMPOSITE_NOTE = "composite PI"


def active_jobs(config: DataFrame, table: str | None = None) -> DataFrame:
    rows = config.where("active")
    if table is not None:
        rows = rows.where(F.upper("source_table") == table.upper())
    return rows.orderBy("source_db", "source_table")


def resolve_cursors(config: DataFrame, columns: DataFrame) -> DataFrame:
    """Cursor column and type per table.

    An explicit type wins; id mode falls back to the primary key; otherwise the
    column's own type decides, and anything unknown counts as time."""
    kind = columns.select(
        "table_name", F.lower("column_name").alias("_name"), F.lower("data_type").alias("_kind")
    )
    candidate = F.coalesce(F.col("watermark_col"), F.col("primary_key"))
    rows = config.withColumn("_want", F.lower(candidate)).join(
        kind, (F.col("source_table") == kind.table_name) & (F.col("_want") == kind["_name"]), "left"
    )
    by_key = F.col("watermark_col").isNull()
    whole = F.coalesce(F.col("_kind").isin(*ID_TYPES), F.lit(False))
    explicit = F.col("watermark_type")
    column = (
        F.when(explicit == "id", candidate)
        .when(explicit == "time", F.col("watermark_col"))
        .when(~by_key | whole, candidate)
    )
    return rows.select(
        *config.columns,
        F.upper(column).alias("cursor_col"),
        F.coalesce(explicit, F.when(whole, "id").otherwise("time")).alias("cursor_type"),
    )


def load_plan(config: DataFrame, force_full: bool = False) -> DataFrame:
    """Full load when asked for, configured, or when no cursor is stored yet."""
    cursor = F.when(
        F.col("cursor_type") == "id", F.col("last_loaded_key").cast("string")
    ).otherwise(F.col("last_loaded_at").cast("string"))
    full = F.lit(force_full) | (F.lower("load_type") == "full") | cursor.isNull()
    return config.withColumn("plan", F.when(full, "full").otherwise("incremental"))


def effective_keys(config: DataFrame) -> DataFrame:
    """The merge keys, else the primary key, upper-cased; no key gives an empty list."""
    listed = F.when(F.size("merge_keys") > 0, F.col("merge_keys"))
    single = F.when(F.col("primary_key").isNotNull(), F.array("primary_key"))
    keys = F.coalesce(listed, single, F.array().cast("array<string>"))
    return config.withColumn("keys", F.transform(keys, F.upper))


def insert_only(existing: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known rows stay as they were tuned; rows with new keys are added."""
    new = found.join(key_set(existing, keys), list(keys), "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def partial_update(
    table: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], clearable: Sequence[str] = ()
) -> DataFrame:
    """Only values given overwrite; a field in ``clearable`` named in the change row's
    ``clear`` list becomes null. ``changes`` holds one row per key."""
    names = [f for f in fields if f in changes.columns]
    new = changes.select(
        key, *[F.col(f).alias(f"_new_{f}") for f in names],
        (F.col("clear") if "clear" in changes.columns else F.array().cast("array<string>")).alias("_clear"),
    )
    joined = table.join(new, key, "left")
    updates = {}
    for f in names:
        value = F.coalesce(F.col(f"_new_{f}"), F.col(f))
        if f in clearable:
            value = F.when(F.coalesce(F.array_contains("_clear", f), F.lit(False)), F.lit(None)).otherwise(value)
        updates[f] = value
    return joined.withColumns(updates).select(*table.columns)


def advance_cursors(cursors: DataFrame, results: DataFrame) -> DataFrame:
    """Cursor table after a run: a success moves the cursor forward, never back; a skip
    or failure leaves it. Every run leaves its status; a success clears the failed step.

    Columns either side lacks (``last_loaded_key``, ``last_run_id``,
    ``last_failed_step``) are left out."""
    ok = F.col("_status") == "success"
    incoming = {
        "last_loaded_at": "new_cursor", "last_loaded_key": "new_key", "last_run_id": "run_id",
        "last_failed_step": "failed_step",
    }
    pairs = {c: n for c, n in incoming.items() if c in cursors.columns and n in results.columns}
    new = results.select("config_id", F.col("status").alias("_status"), *[F.col(n).alias(f"_{n}") for n in pairs.values()])
    updates = {"last_run_status": F.coalesce("_status", "last_run_status")}
    for column, name in pairs.items():
        given = F.col(f"_{name}")
        if column in ("last_loaded_at", "last_loaded_key"):
            updates[column] = F.greatest(F.col(column), F.when(ok, given))
        elif column == "last_failed_step":
            updates[column] = F.coalesce(given, F.when(~F.coalesce(ok, F.lit(False)), F.col(column)))
        else:
            updates[column] = F.coalesce(given, F.col(column))
    return cursors.join(new, "config_id", "left").withColumns(updates).select(*cursors.columns)


def propose_load(
    columns: DataFrame,
    names: Sequence[str] = WATERMARK_NAMES,
    types: Sequence[str] = TIME_TYPES,
    no_key_note: str = NO_KEY_NOTE,
    composite_note: str = COMPOSITE_NOTE,
) -> DataFrame:
    """A load proposal per table from its columns and keys.

    ``columns``: ``(table_name, column_name, data_type, key_position)``, the last one
    null outside the key. A table's columns are bounded by its database, so the list
    of key names stays small."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower("column_name"))
    fits = (rank > 0) & F.lower("data_type").isin(*[t.lower() for t in types])
    key = F.when(
        F.col("key_position").isNotNull(), F.struct("key_position", F.upper("column_name").alias("name"))
    )
    grouped = columns.groupBy("table_name").agg(
        F.min_by(F.upper("column_name"), F.when(fits, rank)).alias("watermark_col"),
        F.sort_array(F.collect_list(key)).getField("name").alias("_keys"),
    )
    count = F.size("_keys")
    notes = F.array_compact(
        F.array(
            F.when(count == 0, no_key_note),
            F.when(count > 1, F.concat(F.lit(f"{composite_note} ("), F.array_join("_keys", ", "), F.lit(")"))),
            F.when(F.col("watermark_col").isNull(), NO_WATERMARK_NOTE),
        )
    )
    review = F.array_join(notes, "; ")
    has_watermark = F.col("watermark_col").isNotNull()
    return grouped.select(
        "table_name",
        F.get("_keys", F.lit(0)).alias("primary_key"),
        F.when(count > 1, F.col("_keys")).alias("merge_keys"),
        "watermark_col",
        F.when(has_watermark & (count > 0), "incremental").otherwise("full").alias("load_type"),
        F.when(count == 1, F.get("_keys", F.lit(0))).alias("partition_col"),
        F.when(count > 0, FULL_PARALLEL).otherwise(1).alias("partition_num"),
        F.nullif(review, F.lit("")).alias("review"),
    )


def sync_label(parity: Column) -> Column:
    return F.when(parity, "in_sync").otherwise("out_of_sync")
