"""Connected components by minimum labels and pointer jumping, on tables that are written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import materialize

#: The rounds grow with the logarithm of the longest path, so these are never reached; if they were, nothing would be returned.
ROUNDS = 64


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, component_id): the least ``least`` of each component. nodes: code, least; edges: a, b between codes.

    Alternates large-star and small-star steps: each links the neighbours of a node to the least of them, so the number
    of rounds grows with the logarithm of the longest path, and the number of edges doesn't grow.
    """
    pairs = materialize(edges.filter("a <> b").select("a", "b").distinct(), "links")
    done = False
    for _ in range(ROUNDS):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: neighbours greater than u link to the least of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = materialize(small.select(F.col("u").alias("a"), F.col("v").alias("b")), "links")
        # finished when all are stars: no node has two roots, and no root is linked to another
        ends = pairs.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        done = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root")).filter("child > 1 OR (child = 1 AND root = 1)").isEmpty()
        if done:
            break
    if not done:
        raise RuntimeError(f"components are unfinished after {ROUNDS} rounds")
    # now a star: every node of a component links to its least code
    member = nodes.join(pairs.groupBy("a").agg(F.min("b").alias("root")), nodes["code"] == F.col("a"), "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(member.join(roots, "root").select("code", "component_id"), "components")
