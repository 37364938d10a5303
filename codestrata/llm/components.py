"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codestrata.llm.storage import stored


def _neighbours(edges: DataFrame, *order) -> DataFrame:
    """`edges` without repetitions, with m, the smallest v of each u: one exchange and one sort for both."""
    own = Window.partitionBy("u").orderBy("v", *order)
    seen = edges.select("*", F.first("v").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.lag("v").over(own).alias("before"))
    return seen.where("before is null or before < v").drop("before")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (u, v longs) that is not the smallest of its component, which
    component names: a node that is not in the result names its own.

    Alternates between tying every larger neighbour to a node's smallest one and tying all smaller
    neighbours together, until nothing moves: about log(n) rounds, each two exchanges of the links.
    Only whether a link moved reaches the driver. Rounds are tables in the shared folder.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = not edges.isEmpty()
    while moved:
        pairs = edges.select("u", "v")
        both = _neighbours(pairs.union(pairs.select("v", "u")))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.expr("m < u").alias("moved"))
        small = _neighbours(large, F.desc("moved"))
        tied = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), F.expr("moved or m < v").alias("moved"))
        edges = stored(tied, "links")
        moved = edges.agg(F.max("moved")).first()[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
