"""Where two sides differ: digests of key ranges as a tree, descended where they disagree, down to the keys.

A leaf is a range of key hashes. Its digest is the number of its rows and sums of 64-bit hashes, so digests of any
parts add up, and a node is the sum of the leaves below it. Each side is read once for its leaves, which may be stored
and compared again; the tree is descended a few bits a step, and only rows of leaves that differ are read for their keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.fingerprint import comparable, exact_hash

#: Bits of a leaf's number, and of the steps on the way to it.
LEAF_BITS, STEPS = 20, (8, 14, 20)


def leaf_of(df: DataFrame, keys: Sequence[str]) -> Column:
    """A row's leaf: the leading bits of its key's hash. Nulls are values of a key here."""
    absent = F.concat(F.lit("k"), *[F.col(f"`{k}`").isNull().cast("int").cast("string") for k in keys])
    return F.shiftrightunsigned(F.xxhash64(*[comparable(df.schema[k]) for k in keys], absent), 64 - LEAF_BITS)


def _hashed(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keys], leaf_of(df, keys).alias("leaf"), exact_hash(df, columns).alias("row"))


def leaves(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(leaf, n, total): at most 2 ** ``LEAF_BITS`` rows, counted where the rows are first."""
    return _hashed(df, keys, columns).groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("total"))


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """The leaves of two trees whose digests differ. Nodes are compared from the top; only leaves below a node that
    differs are looked at in the next step."""
    both = left.select("leaf", F.col("n").cast("bigint"), F.col("total").cast("decimal(38,0)")).unionByName(
        right.select("leaf", (-F.col("n")).alias("n"), (-F.col("total")).cast("decimal(38,0)").alias("total"))
    )
    for bits in STEPS:
        node = F.shiftrightunsigned("leaf", LEAF_BITS - bits)
        sums = both.groupBy(node.alias("node")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        off = sums.where((F.col("n") != 0) | (F.col("total") != 0)).select("node")
        both = both.withColumn("node", node).join(F.broadcast(off), "node", "left_semi").drop("node")
    return both.select("leaf").distinct()


def locate(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
    trees: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The keys on which two sides differ, with ``kind``: ``missing`` in the target, ``extra`` there, or ``changed``, and the rows
    either side has of them. ``trees`` are both sides' leaves, if they are known.

    Values are compared at full precision, in the target's types; of repeated keys all rows must agree. Leaves that differ are at most a
    million numbers, so they are broadcast to the rows."""
    names = list(columns or [c for c in source.columns if c in target.columns])
    source = source.withColumns({n: F.col(f"`{n}`").cast(target.schema[n].dataType) for n in names if source.schema[n].dataType != target.schema[n].dataType})
    left, right = trees or (leaves(source, keys, names), leaves(target, keys, names))
    off = F.broadcast(differing_leaves(left, right))
    sides = []
    for rows, sign in ((source, 1), (target, -1)):
        found = _hashed(rows, keys, names).join(off, "leaf", "left_semi")
        sides.append(found.select(*[F.col(f"`{k}`") for k in keys], F.col("row").cast("decimal(38,0)").alias("row"), F.lit(sign).alias("side")))
    both = sides[0].unionByName(sides[1])
    per_key = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count_if(F.col("side") > 0).alias("source_rows"), F.count_if(F.col("side") < 0).alias("target_rows"), F.sum(F.col("row") * F.col("side")).alias("off")
    )
    kind = F.when(F.col("target_rows") == 0, "missing").when(F.col("source_rows") == 0, "extra").otherwise("changed")
    unequal = (F.col("source_rows") != F.col("target_rows")) | (F.col("off") != 0)
    return per_key.where(unequal).select(*[F.col(f"`{k}`") for k in keys], kind.alias("kind"), "source_rows", "target_rows")
