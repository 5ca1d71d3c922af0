"""Connected components of an edge table by alternating star contraction, with DataFrame operations only.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round at most.
Nodes are compared by value; every node ends beside the smallest node that it can reach. Edges never meet on the driver.
A node with very many neighbours is one join key: both sides of that join are written tables, so adaptive execution may
split the key. Rounds go on until one changes nothing.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.llm import common


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges(a, b) of non-null longs; node, root: every node of an edge with the least node of its component, as a written
    table (common.discard removes it). Raises where a given number of rounds does not settle it."""
    e = common.materialise(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges"
    )
    state = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"components not settled after {rounds} rounds")
        # large star: a node's larger neighbours go to its least neighbour
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = common.materialise(large, "cc-large")
        # small star: a node and its smaller neighbours go to the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        )
        after = common.materialise(small, "cc-edges")
        new = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.discard(e, large)
        e = after
        if tuple(new) == state:
            break
        state = tuple(new)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = common.materialise(out, "cc-nodes")
    common.discard(e)
    return out
