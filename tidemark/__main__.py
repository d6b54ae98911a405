"""``python -m tidemark sync|reconcile|validate|extract|backlog|vacuum tables.json --root <folder>``

``tables.json`` is a list of tables: the fields of ``lifecycle.Table`` plus ``source``,
either ``{"parquet": path}``, ``{"sql": text}`` over catalog tables, or
``{"jdbc": {...}}`` with the fields of ``JdbcTable``. A ``where`` beside them is the table's filter, so that a filter load states its
condition once, with the query it belongs to.
"""

from __future__ import annotations

import argparse
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import lifecycle
from tidemark.session import build_session, settings_for
from tidemark.sources.jdbc import JdbcTable, greatest, measured, read_table
from tidemark.sources.scan import custom_sql


def open_source(spark: SparkSession, source: dict) -> Callable[[], DataFrame]:
    if "parquet" in source:
        return lambda: spark.read.parquet(source["parquet"])
    if "sql" in source:
        return lambda: custom_sql(spark, source["sql"])
    return lambda: read_table(spark, JdbcTable(**source["jdbc"]), source.get("precisions"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("step", choices=["sync", "reconcile", "validate", "extract", "backlog", "vacuum"])
    parser.add_argument("tables")
    parser.add_argument("--root", required=True)
    parser.add_argument("--table", help="only this config_id")
    parser.add_argument("--full", action="store_true", help="sync: load whole tables")
    parser.add_argument("--deep", action="store_true", help="validate: compare row hashes")
    parser.add_argument("--at-once", type=int, default=4)
    parser.add_argument("--as-of", help="UTC time of the run, ISO format")
    parser.add_argument("--data-gb", type=float, help="size of the largest table: sizes splits and shuffles")
    args = parser.parse_args(argv)

    spark = spark or build_session(**(settings_for(int(args.data_gb * 2**30)) if args.data_gb else {}))
    with open(args.tables, encoding="utf-8") as f:
        entries = json.load(f)
    entries = [e for e in entries if args.table in (None, e["config_id"])]
    for e in entries:
        if e["source"].get("where"):
            e["filter"] = e["source"]["where"]
    ceilings = {
        e["config_id"]: partial(greatest, spark, JdbcTable(**e["source"]["jdbc"]), e["cursor_column"])
        for e in entries
        if "jdbc" in e["source"] and e.get("cursor_type") == "id"
    }
    measures = {
        e["config_id"]: partial(measured, spark, JdbcTable(**e["source"]["jdbc"]), e.get("cursor_column"), e.get("filter"))
        for e in entries
        if "jdbc" in e["source"]
    }
    sources = {e["config_id"]: open_source(spark, e.pop("source")) for e in entries}
    tables = [lifecycle.Table(**{**e, **{k: tuple(e.get(k, ())) for k in ("keys", "change_columns")}}) for e in entries]
    as_of = datetime.fromisoformat(args.as_of) if args.as_of else datetime.now(timezone.utc).replace(tzinfo=None)
    run = lifecycle.Run(spark, args.root, f"{as_of:%Y%m%d%H%M%S}-{uuid.uuid4().hex[:6]}", as_of, sources, ceilings, measures=measures)
    step = {
        "sync": partial(lifecycle.sync, force_full=args.full),
        "reconcile": lifecycle.reconcile,
        "validate": partial(lifecycle.validate, deep=args.deep),
        "extract": lifecycle.extract,
        "backlog": lifecycle.load_backlog,
        "vacuum": lifecycle.vacuum,
    }[args.step]
    records = lifecycle.run_all(run, tables, step, args.at_once)
    for r in records:
        print(r["config_id"], r["load_type"], r["status"], r["rows_extracted"], r["rows_loaded"], r["error_message"] or "")
    return records


if __name__ == "__main__":
    main()
