"""Connected components of an edge table, without gathering edges anywhere.

Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce
and Beyond" (2014).  Each step takes the least neighbour of every node (added up before the shuffle)
and joins it back to the edges; a node with very many edges is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; a component is named by its least node.

    Self-loops and repeated edges do no harm; null ends are dropped; without edges the result is empty.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, name), None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(last)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
