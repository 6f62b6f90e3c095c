"""Connected components of an edge table by alternating large-star and small-star steps.

Each step finds the smallest neighbour of a node with partial aggregation and links the others to
it; a step's result is written to the shared folder, which cuts lineage, and the last one's goes.
Hot nodes: nodes with over a thousandth of all rows, hence fewer than a thousand, meet their
neighbours by broadcast, so no task holds the neighbourhood of a hub.

The steps halve the distance to the root, so that `most` rounds settle more nodes than a table holds;
should they not, an error is raised and nothing is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import join_skewed, remove, scratch, shared_dir, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. large: each node's larger neighbours go to its least one; else its smaller ones do."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    joined = join_skewed(both, least, "a", "n")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component."""
    spark = edges.sparkSession
    path = shared_dir(spark, "cc")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", path)
    for _ in range(most):
        with scratch(spark) as stay:
            before, path = path, shared_dir(spark, "cc")
            stay.append(path)
            now = written(_star(written(_star(now, True), "cc-large"), False), "cc", path)
        remove(spark, [before])
        # Settled: every child has one root, and no root is itself a child.
        ends = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select(F.col("a").alias("x"), "n").unionAll(now.select(F.col("b").alias("x"), F.lit(-1).cast("bigint").alias("n")).distinct())
        if ends.groupBy("x").agg(F.max("n").alias("most"), F.min("n").alias("least")).where("most > 1 OR most = 1 AND least = -1").limit(1).count() == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")
