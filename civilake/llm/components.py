"""Connected components of an edge table, with edges only ever joined and grouped on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilake.llm.staging import staged


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``a, b`` (longs); root is the component's smallest node.

    Alternates two steps until the edges no longer change: each node links its
    larger neighbours to its smallest neighbour, then each node links its smaller
    neighbours, and itself, to the smallest of them. Both steps are a grouped
    minimum (combined before the shuffle, so a node with very many neighbours is
    no hot key) and a join back, which adaptive execution may split. Every round
    is staged. Self-loops and repeated edges are allowed; nodes without an edge
    to another node do not appear. No edges give no rows.
    """
    now = staged(edges.where("a <> b").select("a", "b").distinct(), "component-edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "component-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = staged(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "component-edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = seen
