"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that a link names: the smallest node that links reach.

    Links may repeat, run either way and join a node to itself; those with a null end count for nothing. Each round
    takes the least label among neighbours and then that label's own label, so rounds grow with the logarithm of a
    component's diameter. Labels are checkpointed: each round reads the last one's and not its lineage, and as they
    carry no partitioning, a node with very many links can be split by Spark's skew handling.
    """
    both = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = checkpoint(both.select(F.col(a).alias("u"), F.col(b).alias("v")).union(both.select(F.col(b), F.col(a))).distinct())
    labels = checkpoint(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = edges.join(labels, edges.u == labels.node).groupBy(F.col("v").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        lower = checkpoint(lower)
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = lower.join(roots, "component").select("node", F.least("component", "root").alias("component"), "before")
        jumped = checkpoint(jumped)
        labels = jumped.select("node", "component")
        if not jumped.filter("component <> before").limit(1).count():
            return labels
