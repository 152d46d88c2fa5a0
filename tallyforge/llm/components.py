"""Connected components in Spark, by hooking to the least neighbour and contracting.

In every round each node points to the least of itself and its neighbours, pointers are followed once
more, and the edges are rewritten to what their ends point to; edges inside a component vanish. A hub's
edges are reduced by partial minima and split joins, never gathered. Rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Workspace


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(a, b) -> (id, comp) for every id with an edge to another; comp is the least id reachable."""
    left = space.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = space.save(left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct().withColumn("comp", F.col("id")))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = space.save(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("v")).select("u", F.least("u", "v").alias("v")))
        onward = hook.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        root = space.save(hook.join(onward, F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v")))
        of = lambda name: root.select(F.col("u").alias(f"_{name}"), F.col("v").alias(f"{name}_to"))
        moved = space.save(found.join(of("comp"), F.col("comp") == F.col("_comp"), "left").select("id", F.coalesce("comp_to", "comp").alias("comp")))
        shrunk = space.save(
            left.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        )
        space.drop(left, found, hook, root)
        left, found = shrunk, moved
    return found
