"""Time the headline queries and the load paths; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.values import ntz
from tidemark.operators import apply, shape
from tidemark.plans.lifecycle import Run, Table, sync, validate
from tidemark.queries import QUERIES
from tidemark.session import build_session, work_path
from tidemark.sinks.tables import KeyedTable

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "full_scan incr_scan_time incr_scan_id_bounded cdc_multi_col custom_sql_source tsv_decode csv_scan_gzip "
    "dedupe_latest scd1_upsert scd1_upsert_composite scd2_apply reconcile_soft_delete filter_replace backlog_apply "
    "backlog_history keyed_table_upsert schema_drift_apply parity_count parity_watermark parity_deep_hash key_uniqueness "
    "map_types_mysql decode_type_codes propose_load_config cursor_resolution latest_run_per_table stale_tables "
    "error_frequency daily_trend_pivot batch_rollup manifest_retention resume_point log_severity sink_rows_per_file "
    "stream_ingest stream_upsert"
).split()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def load_paths(spark) -> dict[str, float]:
    """Full load, small upsert, empty run and check of one table, start to log row."""
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").withColumn(
        "line_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    cut = ntz("2001-10-20 00:00:00")
    table = Table("lineitem", ("line_id",), cursor_column="l_shipdate", buckets=16)
    root = work_path(spark, "bench")

    def run(rows, day: int):
        return Run(spark, root, f"b{day}-{uuid.uuid4().hex[:6]}", datetime(2002, 1, day), {"lineitem": lambda: rows})

    loaded = lines.where(F.col("l_shipdate") < cut)
    out = {}
    for name, step, rows in (
        ("load_full", sync, loaded),
        ("load_incremental_upsert", sync, lines),
        ("load_no_new_rows", sync, lines),
        ("load_validate_deep", lambda r, t: validate(r, t, deep=True), lines),
    ):
        done = []
        out[name] = timed(lambda s=step, r=rows: done.append(s(run(r, len(out) + 1), table)))
        expected = "skipped" if name == "load_no_new_rows" else "success"
        if done[0]["status"] != expected:
            raise RuntimeError(f"{name}: {done[0]}")
        if name == "load_full":
            out["_full_rows"] = done[0]["rows_loaded"]
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    stored = KeyedTable(spark, work_path(spark, "sparse"), ("line_id",), 16, file_rows=4000, file_bytes=1, prune_from=0)
    stored.create(shape.with_audit(lines, ntz("2001-01-01 00:00:00"), "b0"))
    few = lines.where(F.xxhash64("line_id") % 20_000 == 0)
    for name in ("sparse_delta_without_index", "sparse_delta"):
        did = []
        change = lambda t, d, small: apply.upsert(t, d, ["line_id"], ntz("2002-01-01 00:00:00"), "b1", small=small)
        out[name] = timed(lambda n=name: did.append(stored.apply(few, change, n)))
        if did[0].rewritten > 1.2 * few.count() or not did[0].left:
            raise RuntimeError(f"{name}: {did[0]}")
    target = shape.with_audit(orders, ntz("2001-01-01 00:00:00"), "b0")
    out["apply_upsert_all_orders"] = timed(
        lambda: noop(apply.upsert(target, orders, ["o_orderkey"], ntz("2002-01-01 00:00:00"), "b1", "o_orderdate"))
    )
    return out


def main() -> None:
    only = sys.argv[1:]
    spark = build_session(
        "tidemark-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count())
    times = {name: timed(lambda n=name: noop(QUERIES[n](spark, SF_DIR))) for name in (only or HEADLINE)}
    extra = {}
    if not only:
        times.update(load_paths(spark))
        extra = {"full_load_rows_per_sec": round(times.pop("_full_rows") / times["load_full"])}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
