"""Connected components of a graph of links, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges``.

    Each round takes the minimum over the neighbours and then the root of the root, so chains
    halve; rounds go on until nothing changes. Lineage is cut by checkpoint() in each round. A node
    with very many links is one skewed join key, which adaptive execution splits.
    """
    both = (edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
            .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
            .where("node <> other").distinct().checkpoint())
    roots = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
    roots = roots.checkpoint()
    while True:
        near = (both.join(roots.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("root").alias("m")))
        # Written before the next join, so that both its sides are plain exchanges and a root with
        # very many nodes can be split.
        step = roots.join(near, "node").select("node", "root", F.least("root", "m").alias("next")).checkpoint()
        up = step.select(F.col("node").alias("next"), F.col("next").alias("above"))
        step = (step.join(up, "next").select("node", "root", F.least("next", "above").alias("next")).checkpoint())
        changed = step.where("next <> root").limit(1).count()
        roots = step.select("node", F.col("next").alias("root"))
        if not changed:
            return roots
