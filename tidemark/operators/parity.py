"""Does the target hold what the source holds: counts, watermarks, hashes, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidemark.functions.fingerprint import comparable, exact_hash, table_hash, with_slices
from tidemark.functions.values import second_text
from tidemark.operators.shape import live_rows


def row_count(df: DataFrame, condition: str | None = None) -> DataFrame:
    return (df.where(F.expr(condition)) if condition else df).agg(F.count(F.lit(1)).alias("row_count"))


def max_watermark(target: DataFrame, column: str) -> DataFrame:
    """Greatest watermark over live rows, as text."""
    return live_rows(target).agg(F.max(column).cast("string").alias("max_watermark"))


def delta_watermark(delta: DataFrame, column: str, cursor: Column | None = None) -> DataFrame:
    """Rows extracted and the cursor they lead to; the cursor never moves back."""
    newest = F.max(column)
    if cursor is not None:
        newest = F.coalesce(F.greatest(newest, cursor), cursor)
    return delta.agg(F.count(F.lit(1)).alias("row_count"), newest.alias("new_watermark"))


def _side(rows: DataFrame, name: str, measures: dict[str, Column]) -> DataFrame:
    """One row of measures for one side. Each side is aggregated alone, so only one
    row per side reaches the comparison."""
    return rows.agg(*[m.alias(n) for n, m in measures.items()]).withColumn("_side", F.lit(name))


def _compare(source: DataFrame, target: DataFrame, measures: Sequence[str]) -> DataFrame:
    both = source.unionByName(target)
    return both.agg(
        *[
            F.max(F.when(F.col("_side") == side, F.col(m))).alias(f"{side}_{m}")
            for m in measures
            for side in ("source", "target")
        ]
    )


def _watermark(rows: DataFrame, column: str) -> Column:
    timed = isinstance(rows.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return second_text(F.max(column)) if timed else F.max(column).cast("string")


def count_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    measure = {"rows": F.count(F.lit(1))}
    out = _compare(_side(source, "source", measure), _side(live_rows(target), "target", measure), ["rows"])
    return out.select(
        "source_rows",
        "target_rows",
        (F.col("source_rows") - F.col("target_rows")).alias("delta"),
        (F.col("source_rows") == F.col("target_rows")).alias("count_ok"),
    )


def watermark_parity(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Greatest watermark on both sides, compared at second precision."""
    out = _compare(
        _side(source, "source", {"wm": _watermark(source, column)}),
        _side(live_rows(target), "target", {"wm": _watermark(target, column)}),
        ["wm"],
    )
    return out.withColumn("wm_ok", F.col("source_wm").eqNullSafe(F.col("target_wm")))


def hash_parity(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and order-independent hashes of the named columns."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return _side(with_slices(rows, columns), name, {"rows": F.count(F.lit(1)), "hash": table_hash()})

    out = _compare(side(source, "source"), side(live_rows(target), "target"), ["rows", "hash"])
    return out.withColumn("hash_ok", F.col("source_hash") == F.col("target_hash"))


def parity(
    source: DataFrame,
    target: DataFrame,
    columns: Sequence[str] | None = None,
    watermark: str | None = None,
    deep: bool = False,
    exact: bool = False,
    known: tuple[int, str | None] | None = None,
    fixed: bool = True,
) -> DataFrame:
    """All checks of one table in a single row; source and target are read once each.

    The fixed row hash cuts floats to two decimals and cancels equal pairs, so it can miss
    differences. ``exact`` adds a second measure that does neither (``exact_hash``, on the target's
    types) and lets it decide; without ``fixed`` the fixed hash, which costs most, is then left out. ``known`` is the source's count and watermark, if the source has told
    them itself; the source is then not read."""
    names, live = list(columns or source.columns), live_rows(target)
    if exact:
        source = source.withColumns({n: F.col(n).cast(live.schema[n].dataType) for n in names if source.schema[n].dataType != live.schema[n].dataType})

    def side(rows: DataFrame, name: str) -> DataFrame:
        measures = {"rows": F.count(F.lit(1))}
        measures["wm"] = _watermark(rows, watermark) if watermark else F.max(F.lit(None).cast("string"))
        measures["hash"] = table_hash() if deep and fixed else F.max(F.lit(None).cast("string"))
        if exact:
            measures["sum"] = F.sum(F.col("_exact").cast("decimal(38,0)")).cast("string")
        keep = [F.col(watermark)] if watermark else []
        keep += [exact_hash(rows, names).alias("_exact")] if exact else []
        read = rows if not deep else with_slices(rows, names, keep) if fixed else rows.select(*keep)
        return _side(read, name, measures)

    if known is not None:
        row = {"rows": F.lit(known[0]).cast("bigint"), "wm": F.lit(known[1]), "hash": F.lit(None).cast("string")}
        left = target.sparkSession.range(1).select(*[v.alias(n) for n, v in row.items()], F.lit("source").alias("_side"))
    else:
        left = side(source, "source")
    out = _compare(left, side(live, "target"), ["rows", "wm", "hash", *(["sum"] if exact else [])])
    checked = out.withColumns(
        {
            "delta": F.col("source_rows") - F.col("target_rows"),
            "count_ok": F.col("source_rows") == F.col("target_rows"),
            "wm_ok": F.col("source_wm").eqNullSafe(F.col("target_wm")),
            "hash_ok": F.col("source_hash").eqNullSafe(F.col("target_hash")),
        }
    )
    decisive = F.col("hash_ok")
    if exact:
        checked = checked.withColumn("sum_ok", F.col("source_sum").eqNullSafe(F.col("target_sum")))
        decisive = F.col("sum_ok")
    return checked.withColumn("ok", F.col("count_ok") & F.col("wm_ok") & decisive)


def rows_per_file(df: DataFrame, file: Column | None = None) -> DataFrame:
    """Rows per source file. Map tasks count first, so a large file costs one row each."""
    name = file if file is not None else F.col("_metadata.file_name")
    return df.groupBy(name.alias("file_name")).agg(F.count(F.lit(1)).alias("row_count"))


def file_report(counts: DataFrame) -> DataFrame:
    """The per-file report as lines, with the total over all files."""
    lines = counts.select(F.concat_ws(" : ", "file_name", F.col("row_count").cast("string")).alias("line"))
    total = counts.agg(F.concat(F.lit("TOTAL : "), F.coalesce(F.sum("row_count"), F.lit(0)).cast("string")).alias("line"))
    return lines.unionByName(total)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Is the key unique: total rows, distinct keys, verdict. Two counting steps and no
    distinct list on one task."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys")
    ).withColumn("is_unique", F.col("total_rows") == F.col("distinct_keys"))


def sketched_keys(df: DataFrame, candidates: Sequence[Sequence[str]], slack: float = 0.05) -> DataFrame:
    """One row per candidate key: how many rows have a null in it, and about how many values it has. All sketches come from one scan; they are
    mergeable, so tasks send one each per candidate. ``plausible`` says that the estimate doesn't rule a unique key out."""
    total = F.count("*")
    measures = [total.alias("rows")]
    for i, keys in enumerate(candidates):
        values = [comparable(df.schema[k]) for k in keys]
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(f"`{k}`").isNotNull()
        measures.append(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(whole, F.xxhash64(*values)), 14)).alias(f"d{i}"))
        measures.append(F.count_if(~whole).alias(f"n{i}"))
    row = df.agg(*measures)
    each = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(", ".join(k)).alias("keys"), F.lit(len(k)).alias("width"), F.col(f"d{i}").alias("about"), F.col(f"n{i}").alias("null_rows"))
        for i, k in enumerate(candidates)
    ])
    found = row.select("rows", F.inline(each))
    plausible = (F.col("null_rows") == 0) & (F.col("about") >= F.col("rows") * (1 - slack))
    return found.withColumn("plausible", plausible)


def propose_key(df: DataFrame, candidates: Sequence[Sequence[str]], slack: float = 0.05) -> tuple[list[str], DataFrame] | None:
    """The first candidate that is a key, of few columns first, with its exact check; None if none is. Sketches of all candidates rule most of
    them out in one scan, and only what they leave is checked exactly, until one holds."""
    told = sketched_keys(df, candidates, slack).where("plausible").orderBy("width", "rank").collect()  # one row per candidate
    for r in told:
        check = key_check(df, candidates[r["rank"]])
        if check.first().is_unique:
            return list(candidates[r["rank"]]), check
    return None
