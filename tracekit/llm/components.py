"""Connected components of an undirected graph by alternating large-star and small-star steps.

Both steps only ever need each node's smallest neighbour, so a node with very many neighbours
costs a map-side-combined minimum and a join that adaptive execution can split; no
neighbourhood is gathered anywhere. Edges are settled after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracekit.llm.common import settle, ship

ship(__name__)

MAX_ROUNDS = 100  # far above the logarithmic need; reaching it is an error


def _least(pairs: DataFrame) -> DataFrame:
    """For each u of (u, v): the least of u and its v's."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another one.

    Self-loops, nulls and repeated edges are ignored; an empty table gives an empty one.
    """
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = settle(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = large.join(_least(large), "u")
        nxt = settle(small.select("u", F.col("m").alias("v"))
                     .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                     .where("u <> v").distinct())
        old, new = (x.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (e, nxt))
        e = nxt
        if old == new:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
