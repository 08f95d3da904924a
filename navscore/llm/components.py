"""Connected components of a distributed edge list, by hooking and pointer jumping.

Every round hooks each node to the smallest node it touches; the trees that this makes are
flattened by jumping from parent to grandparent, which halves their depth each time, and the
edges are rewritten to the roots. A chain of ``n`` nodes takes about ``log2(n)`` jumps. Nodes
and edges stay distributed, only "is an edge left" and "has a node moved" reach the driver.
Neighbour lists are never gathered: minima combine on the map side, and the joins on a node
with very many edges are plain sort-merge joins whose large partitions are split at run time.
Steps are written to the shared scratch folder, so a lost executor costs one step at most.

Defined cases: loops and repeated edges have no effect; edges without rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.llm.common import stored


def flattened(hooks: DataFrame) -> DataFrame:
    """``hooks`` (node, root) with every node led to the root of its tree."""
    while True:
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        jumped = hooks.join(onward, "root").select(
            "node", F.col("onward").alias("root"), (F.col("onward") != F.col("root")).alias("moved")
        )
        jumped = stored(jumped, "jumps")
        hooks = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a`` and ``b``)."""
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(
            both.groupBy("a").agg(F.min("b").alias("low"))
            .select(F.col("a").alias("node"), F.least("a", "low").alias("root")),
            "hooks",
        )
        hooks = flattened(hooks)
        if labels is None:
            labels = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            labels = stored(
                labels.join(onward, "root", "left").select(
                    "node", F.coalesce("onward", "root").alias("root")
                ),
                "labels",
            )
        low_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        low_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(
            edges.join(low_a, "a").join(low_b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
