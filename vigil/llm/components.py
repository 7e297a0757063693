"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a, b)``; root is the component's smallest node.

    A round gives each node the smallest label among itself and its neighbours, then the label of
    that label. Labels are written each round, which cuts the lineage and leaves plain tables on
    both sides of each join, so a node with very many neighbours is split by the skew join; sums of
    its neighbours are combined before the shuffle. Nothing but the question whether a label changed
    comes to the driver. Self loops and repeated edges do no harm; an edge with a null end is no edge.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("root")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("via"))
        step = materialize(step, "cc-step")
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        after = step.join(jump, "via").select("node", F.least("via", "far").alias("root"), (F.least("via", "far") != F.col("old")).alias("moved"))
        after = materialize(after, "cc-labels")
        labels = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return labels
