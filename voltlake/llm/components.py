"""Distributed connected components by alternating large-star and small-star contractions.

Only DataFrame operations. Each star takes the smallest neighbour of every node with a
partially aggregated group, then joins it back on the edges; a hub's edges lie on one side of
a plain sort-merge join, which adaptive execution splits. No adjacency list is ever collected.
The lineage is cut with checkpoint() in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node that has an edge
    to another. Nulls and self-links are left out; repeated and reversed links are harmless.
    An empty table gives an empty result. Raises if `max_rounds` don't suffice."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = e.distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
        if not state["n"] or seen == tuple(state):
            return _stars(e)
        seen = tuple(state)
        e = _small_star(_large_star(e)).checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def _stars(e: DataFrame) -> DataFrame:
    """Settled edges lead from each node to its root."""
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
