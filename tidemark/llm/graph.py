"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b): root is the smallest node reachable.

    Each round every node takes the smallest root among its own, its neighbours' and its
    root's, which also halves the way to the root. Roots are written to the shared folder each
    round, so lineage stays short, a lost executor costs one round, and a node with very many
    neighbours is a skewed join partition between two plain tables, which Spark splits. Only the
    number of changed roots comes to the driver."""
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = saved(links.select("a", "b").unionByName(back).distinct(), "links")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        # the smallest root a node or a neighbour has; then that root's own root
        near = both.join(roots.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        jumped = roots.join(up, "root").select("node", F.col("up").alias("root"), F.col("root").alias("old"))
        found = jumped.unionByName(near.withColumn("old", F.lit(None).cast("long")))
        after = saved(found.groupBy("node").agg(F.min("root").alias("root"), F.min("old").alias("old")), "roots")
        roots = after.select("node", "root")
        if after.where("root < old").isEmpty():
            return roots
