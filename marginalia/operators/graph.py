"""Layers of a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.streaming.tables import checkpointed


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): 0 without dependencies, else one more than the greatest layer among them. ``edges``: (node, needs).
    Dependencies on nodes that aren't there, and cycles, are an error. Joins are by sorting, as a small side that is
    broadcast would go through the driver anew in each layer."""
    loose = edges.join(nodes.select(F.col("node").alias("needs")).hint("merge"), "needs", "left_anti")
    if loose.limit(1).count():
        raise ValueError("a dependency is missing")
    left = checkpointed(nodes.select("node").distinct())
    done, layer = None, 0
    while True:
        waits = edges.join(left.select(F.col("node").alias("needs")).hint("merge"), "needs", "left_semi").select("node").distinct()
        ready = checkpointed(left.join(waits.hint("merge"), "node", "left_anti").withColumn("layer", F.lit(layer)))
        if not ready.limit(1).count():
            break
        done = ready if done is None else done.unionByName(ready)
        left, layer = checkpointed(left.join(ready.hint("merge"), "node", "left_anti")), layer + 1
    if left.limit(1).count():
        raise ValueError("the graph has a cycle")
    return done if done is not None else left.withColumn("layer", F.lit(0))
