"""Connected components of a graph given as a DataFrame of edges.

Alternating large-star and small-star steps (Kiveris and others, 2014). Each step keeps, per node,
only the smallest neighbour (a partial aggregate, so a hub is summed up before it is shuffled) and
joins it back by node; joins on a hub are skew joins that the adaptive planner splits. After every
round the edges are a written table, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # A node's smaller neighbours and the node itself all point to the smallest of them.
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    Edges with a null end and loops are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    held = durable(pairs, "edges")
    before = None
    for done in range(rounds):
        if done == 1:  # nothing has settled after one round but graphs that were stars already
            held = durable(_star(_star(held, True), False), "edges")
            continue
        mark = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = mark
        held = durable(_star(_star(held, True), False), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
