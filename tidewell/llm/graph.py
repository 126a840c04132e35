"""Connected components of a large graph, without the driver holding nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, staged

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a, b`` long); ``root`` is its component's smallest node.

    Alternates large-star and small-star steps, which keep the components and shrink every one to a
    star around its smallest node in a logarithmic number of rounds.  A node's neighbourhood is only
    ever aggregated to its minimum, so a hub costs one row a task; each round is written to the
    shared folder, which cuts the lineage.
    """
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "node")
        # large star: greater neighbours go to the least one of the neighbourhood
        large = both.join(least, both["a"] == least["node"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the least one
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        joined = large.join(low, large["a"] == low["node"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        following = staged(small, "edges")
        # stars only: no node is both a leaf and a centre, and every leaf has one centre
        busy = following.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        centres = following.select(F.col("b").alias("a")).distinct()
        done = busy.where("n > 1").limit(1).count() == 0 and busy.join(centres, "a", "left_semi").limit(1).count() == 0
        discard(current)
        current = following
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
