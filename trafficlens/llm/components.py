"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_turns: int = 60) -> DataFrame:
    """(u, v) edges to (node, component) for every node that isn't its component's least.

    Alternates large-star (neighbours above a node move to its least neighbour)
    and small-star (the same for those below it) until nothing changes; edges
    then form stars around the least node. Each turn reads the table that the
    last one wrote.
    """
    edges = stored(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(edges)
    for _ in range(most_turns):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(edges.join(least, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.union(low.toDF("u", "v")).distinct(), "edges")
        after = _digest(edges)
        if after == before:
            return edges.toDF("node", "component")
        before = after
    raise RuntimeError("components did not settle")
