"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return tied.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of the component, for every node that has an edge to another, from edges (a, b).

    Each round is a grouping and a join for each of the two steps, on tables no larger than the edges, written to the
    shared folder; a hub is one row on the grouped side of a join. The number of rounds grows with the logarithm of the
    nodes.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        now = stored(_small(_large(now)), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == last:
            break
        last = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
