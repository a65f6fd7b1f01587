"""Connected components by repeated contraction, without gathering edges or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that is reachable, for every node on an edge.

    Each round every node hooks onto its neighbour of least random priority (a hash of the node, then the node),
    itself included, and the graph is contracted by that map.  Hooks lead strictly downwards, so there are no
    cycles; a path or a star shrinks by a constant factor a round.  The rounds' maps are composed at the end.
    Minima are aggregated before they are shuffled, so that a node with very many edges costs no task more.
    Loops, repeated and null edges are allowed: loops and nulls are left out.
    """
    mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    live = checkpoint(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("n"), F.col("b").alias("m")).union(live.select("b", "a"))
        hooks = both.groupBy("n").agg(F.min(mark("m")).alias("least"))
        hooks = checkpoint(hooks.select("n", F.least(mark("n"), "least")["n"].alias("p")))
        maps.append(hooks)
        one = live.join(hooks.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a")
        two = one.join(hooks.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b").filter("pa <> pb")
        live = checkpoint(two.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).filter("false")
    roots = maps[-1]
    for hooks in reversed(maps[:-1]):
        above = roots.select(F.col("n").alias("p"), F.col("p").alias("root"))
        roots = hooks.join(above, "p", "left").select("n", F.coalesce("root", "p").alias("p"))
    roots = checkpoint(roots)
    least = roots.groupBy("p").agg(F.min("n").alias("component"))
    return roots.join(least, "p").select(F.col("n").alias("node"), "component")
