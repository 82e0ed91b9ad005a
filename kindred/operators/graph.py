"""Graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written as _written


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component = least node reachable): least labels, hooking and a pointer jump, a written table per round.

    Rounds end when no label changed; labels that still change after so many rounds raise.
    """
    links = _written(both_ways(edges))
    labels = _written(links.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    for _ in range(rounds):
        near = links.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("new"))
        # a node's label also lowers its label's label: a root learns it in the same round
        hooked = moved.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("h"))
        low = _written(moved.join(hooked, "node", "left").select("node", "old", F.least("new", F.coalesce("h", "new")).alias("new")))
        up = low.select(F.col("node").alias("new"), F.col("new").alias("top"))
        after = _written(low.join(up, "new", "left").select("node", "old", F.least("new", F.coalesce("top", "new")).alias("component")))
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"component labels still change after {rounds} rounds")


def counts(edges: DataFrame) -> DataFrame:
    """(nodes, edges) of a graph that holds every edge in both directions."""
    return edges.agg(F.count_distinct("src").alias("nodes"), F.expr("count(*) div 2").alias("edges"))


def hops(edges: DataFrame, seeds: DataFrame, n: int = 2, sample: int | None = None) -> DataFrame:
    """(node, hop) reached in up to n steps, nearest hop first; seeds have hop 0.

    sample: from the second step on only so many nodes of the front, chosen by a hash, are gone on
    from (the reference's bound on look-ups); the others are reached all the same.
    """
    seen = seeds.select("node", F.lit(0).cast("long").alias("hop")).distinct()
    front = seen
    for k in range(1, n + 1):
        if sample is not None and k > 1:
            front = front.orderBy(F.md5(F.col("node").cast("string")), "node").limit(sample)
        reached = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        front = reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(k).cast("long"))
        seen = seen.unionByName(front)
    return seen
