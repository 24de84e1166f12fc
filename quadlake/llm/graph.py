"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (src, dst); the label is one of the nodes.

    In each round every node hooks on to its least neighbour if that is less, and the
    edges move to the hooks; edges within a hook go. Each round at least halves the nodes
    of a component. Null ends and loops are ignored. Rounds are written to the shared
    folder.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = cut(both.groupBy("src").agg(F.min("dst").alias("least"))
                    .select(F.col("src").alias("node"), F.least("src", "least").alias("label")))
        a = hooks.select(F.col("node").alias("src"), F.col("label").alias("a"))
        b = hooks.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        edges = cut(edges.join(a, "src").join(b, "dst").where("a <> b")
                    .select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        if total is None:
            total = hooks
        else:
            further = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            total = (total.join(further, "label", "left")
                     .select("node", F.coalesce("next", "label").alias("label")))
    return total if total is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))
