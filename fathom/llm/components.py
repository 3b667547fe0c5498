"""Connected components by alternating large-star and small-star, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import written

#: Edges up to which least neighbours are broadcast (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_EDGES = 200_000


def _star(edges: DataFrame, small: bool, few: bool) -> DataFrame:
    """One star operation on edges (u, v), u > v.

    Large: every larger neighbour of a node is tied to the least node of its neighbourhood. Small: the node and its smaller
    neighbours are tied to the least of them. few: their number has been checked to be BROADCAST_EDGES at most.
    """
    around = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # beyond the broadcast, a node with very many neighbours is a skewed join key, which adaptive execution splits
    tied = around.join(F.broadcast(least) if few else least, "u")
    if small:
        out = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
    else:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either tied to one node that is tied to none itself, or such a node."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("tied"), F.lit(0).alias("center")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("tied"), F.lit(1).alias("center")))
    return ends.groupBy("id").agg(F.sum("tied").alias("n"), F.max("center").alias("c")).where("n > 1 or (n = 1 and c = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node in edges (a, b): label is the least id that can be reached. Nulls and loops are passed over; no edges, no rows.

    Star operations alternate until stars are left; the number of rounds grows with the logarithm of the component's size.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        few = now.count() <= BROADCAST_EDGES
        now = written(_star(_star(now, small=False, few=few), small=True, few=few).distinct(), "edges")
        if _are_stars(now):
            return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
