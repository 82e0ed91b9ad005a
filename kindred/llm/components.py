"""Connected components as joins: nothing about links or nodes comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for the ends of links (a, b); component is the smallest node reachable.

    Each round every link hands the smaller label over, then labels are shortened by one
    pointer jump; rounds end when no label changed, and labels that still change after so many
    rounds raise.  Each round's labels are a written table.  Joins on nodes of many links and on
    labels of many nodes are salted.  Null ends are ignored; no links give no rows.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = written(labels, "labels")
    for _ in range(rounds):
        told = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = salted_join(both, told, "b", "a").groupBy("a").agg(F.min("c").alias("c"))
        # a node's label also lowers its label's label (hooking), then labels jump
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("new"))
        hooked = moved.select(F.col("old").alias("node"), F.col("new").alias("h")).groupBy("node").agg(F.min("h").alias("h"))
        low = moved.join(hooked, "node", "left").select("node", "old", F.least("new", F.coalesce("h", "new")).alias("new"))
        low = written(low, "labels")
        up = low.select(F.col("node").alias("new"), F.col("new").alias("top"))
        after = salted_join(low, up, "new", "node", "left").select("node", "old", F.least("new", F.coalesce("top", "new")).alias("component"))
        after = written(after, "labels")
        labels = after.select("node", "component")
        if after.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"component labels still change after {rounds} rounds")
