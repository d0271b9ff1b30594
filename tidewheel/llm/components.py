"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, drop


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tasks: int | None = None, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest
    node reachable. Edges may repeat, point either way or be loops.

    Large-star links every larger neighbour of a node to the smallest one it
    knows, small-star does so for the smaller ones; both keep connectivity and
    the number of edges does not grow, so no group is ever collected. The
    minima are written before they are joined: both join sides are then plain
    exchanges, whose skewed partitions Spark can split (a hub may hold a third
    of all edges). It ends when every node has one parent and no parent has one.
    tasks: tasks for tables of as many rows as there are nodes."""
    pairs = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), tasks)
    for _ in range(max_rounds):
        if _settled(pairs, tasks):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), tasks)
        large = cut(both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tasks)
        drop(pairs, low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), tasks)
        linked = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tasks)
        drop(large, low)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(pairs: DataFrame, tasks: int | None) -> bool:
    """Whether the edges are stars with their smallest node in the middle."""
    ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sides = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    wrong = sides.where("up > 1 or (up = 1 and down = 1)")
    return (wrong.coalesce(tasks) if tasks else wrong).isEmpty()
