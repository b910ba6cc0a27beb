"""Connected components of an edge table, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.tables import stage_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the smallest node reachable.

    Alternating large-star / small-star contraction: each round links a node's larger (then its
    smaller) neighbours to the smallest one, so the number of rounds is logarithmic in the longest
    path. Only grouped minima and joins on the node are used; each round is a table in the shared
    folder. Self-edges and repeated edges are allowed; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage_table(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(e.filter("a = b")).distinct()
        # small star: every smaller neighbour, and the node itself, is linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        e = stage_table(small.filter("a >= b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    return e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
