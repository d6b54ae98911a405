"""Mixing sources to target weights, by thresholds on a hash.

A document's hash is a number of 60 bits that depends on its id alone, where ids are unique. Each source takes the
documents whose hash is below its threshold, and the threshold is where the sizes below it come
nearest the budget. It is found 10 bits at a time: sizes are summed by source and hash bucket,
the bucket where the budget runs out is the boundary, and only that bucket's documents, kept apart, are
summed again by the next 10 bits. Nothing is sorted but at most 1024 sums of a source.
Thresholds of larger budgets lie above those of smaller ones, so mixes are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import digest60, saved, small_side, whole_row, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
_STEP, _LEVELS = 10, 6


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): all sizes are shared by weight, the
    weights going round the sources in code-point order with null last; a target stops at ``most``
    times its source's size and the excess goes to the others by weight, until none is above.

    One row per source: the windows here order sources, not documents."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.row_number().over(by_name) - 1
    shares = F.array(*(F.lit(int(w)) for w in weights))
    rows = sizes.select("source", "source_size", F.get(shares, turn % len(weights)).cast("decimal(38,0)").alias("weight"))
    rows = rows.withColumn("cap", (F.col("source_size") * most).cast("decimal(38,0)"))
    # sources reach their cap in order of cap / weight; those before have taken theirs off the share
    order = Window.orderBy(F.col("source_size") / F.col("weight").cast("double"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("decimal(38,0)")
    left = F.sum("source_size").over(every).cast("decimal(38,0)") - F.coalesce(F.sum("cap").over(before).cast("decimal(38,0)"), zero)
    weight_left = F.sum("weight").over(every).cast("decimal(38,0)") - F.coalesce(F.sum("weight").over(before).cast("decimal(38,0)"), zero)
    rows = rows.select("*", left.alias("left"), weight_left.alias("weight_left"))
    rows = rows.withColumn("full", F.col("cap").cast("double") * F.col("weight_left").cast("double") <= F.col("weight").cast("double") * F.col("left").cast("double"))
    open_ = F.when(~F.col("full"), F.struct("left", "weight_left"))
    rows = rows.withColumn("open", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("weight").cast("double") * (F.col("open.left").cast("double") / F.col("open.weight_left").cast("double"))
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _bits(hash_: Column, level: int) -> Column:
    return F.shiftrightunsigned(hash_, 60 - _STEP * (level + 1)).bitwiseAND(F.lit((1 << _STEP) - 1))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``whole`` (copies that every document gets) and ``below``: documents whose hash
    is less get one more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = saved(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    # (source, prefix of the boundary bucket, budget left inside it)
    edge = plan.select("source", F.lit(0).cast("long").alias("prefix"), "budget")
    for level in range(_LEVELS):
        if level == 1:  # from here on only documents of boundary buckets matter, about a thousandth
            here = F.shiftrightunsigned("hash", 60 - _STEP) == edge["prefix"]
            sized = saved(sized.join(edge, sized["source"].eqNullSafe(edge["source"]) & here).select(sized["source"], "size", "hash"), "mix-boundary")
        prefix = F.shiftrightunsigned("hash", 60 - _STEP * level)
        inside = sized.join(edge, sized["source"].eqNullSafe(edge["source"]) & (prefix == edge["prefix"])).select(
            edge["source"], "prefix", "budget", sized["size"], _bits(F.col("hash"), level).alias("bucket")
        )
        sums = saved(inside.groupBy("source", "prefix", "budget", "bucket").agg(F.sum("size").alias("size")), "mix-histogram")
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        taken = sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0).cast("long")))
        # the last bucket that begins within the budget holds the boundary
        at = F.max(F.struct("bucket", "before", "size")).alias("at")
        edge = taken.where("before <= budget").groupBy("source", "prefix", "budget").agg(at)
        edge = edge.select(
            "source",
            (F.shiftleft("prefix", _STEP) + F.col("at.bucket")).alias("prefix"),
            (F.col("budget") - F.col("at.before")).alias("budget"),
            F.col("at.size").alias("edge_size"),
        )
        edge = saved(edge, "mix-edge")
    # one hash value is left: it is taken if that brings the sum nearer
    last = edge.select(F.col("source").alias("edge_source"), F.when(F.col("edge_size") < 2 * F.col("budget"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    joined = plan.join(last, plan["source"].eqNullSafe(last["edge_source"]), "left")
    return joined.select("source", "source_size", "target", "whole", F.coalesce("below", F.lit(0).cast("long")).alias("below"))


def _spread(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (``hash``, ``same``, ...) in which rows of one hash have one each: of (hash, same) and a number among equals.

    Rows are numbered where they lie, and the counts of the tasks before are added, so a hash of very many rows meets in no task. Equal rows may
    swap numbers, which changes nothing."""
    once = rows.join(small_side(repeated), "hash", "left_anti")
    again = rows.join(small_side(repeated), "hash", "left_semi").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    again = saved(again, "mix-repeats")
    group = ["hash", "same"]
    held = again.groupBy(*group, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*group, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("offset"))
    number = F.row_number().over(Window.partitionBy(*group, "part").orderBy("at")) + F.col("offset")
    again = again.join(held, [*group, "part"]).withColumn("hash", digest60(F.concat_ws("/", "hash", "same", number)))
    return once.unionByName(again.select(*once.columns))


def _keyed(docs: DataFrame, id_col: str, text: str, source: str) -> tuple[Column, Column]:
    """A row's hash, and what tells rows of one hash apart."""
    return digest60(F.col(id_col)).alias("hash"), F.xxhash64(F.col(source), F.col(text), F.col(source).isNull(), F.col(text).isNull()).alias("same")


def _plan(docs: DataFrame, id_col: str, text: str, source: str, weights: Sequence[int], most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Sizes with their hashes, thresholds, and the hashes that several rows have, if any."""
    hash_, same = _keyed(docs, id_col, text, source)
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hash_, same), "mix-sizes")
    repeated = saved(sized.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "mix-repeated")
    if repeated.isEmpty():
        repeated = None
    else:
        sized = saved(_spread(sized, repeated), "mix-sizes")
    sizes = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    return sized, saved(thresholds(sized, targets(sizes, weights, most)), "mix-thresholds"), repeated


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (words), ``source_size``, ``target`` and ``copies``, how
    often the mix takes it.

    A null source is a source of its own. Null and empty texts have size 0 and get the copies that
    their hash gives, which adds no words; if a source has no words its documents get none. Rows
    with the same id, null included, are told apart by source, text and a number among equals, so that they are
    taken one by one. An empty table gives no rows; other columns are not read."""
    sized, plan, _ = _plan(docs, id_col, text, source, weights, most)
    plan = plan.withColumnRenamed("source", "plan_source")
    out = sized.join(plan, sized["source"].eqNullSafe(plan["plan_source"]))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``mixed`` says, all columns kept."""
    _, plan, repeated = _plan(docs, id_col, text, source, weights, most)
    plan = plan.select(F.col("source").alias("plan_source"), "whole", "below")
    hash_, same = _keyed(docs, id_col, text, source)
    keyed = docs.select(whole_row(docs).alias("row"), F.col(source).alias("of"), hash_, *([same] if repeated else []))
    keyed = _spread(keyed, repeated) if repeated else keyed
    out = keyed.join(plan, F.col("of").eqNullSafe(F.col("plan_source")))
    copies = (F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
