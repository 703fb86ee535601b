"""Connected components of an undirected graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges(a, b).

    Each round a node takes the least label of its neighbours, and then the label of its label,
    so the rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder, which ends the lineage.

    Cases: edges with a null end, loops and repeated edges change nothing; no edges give no rows.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("at"))
        stepped = written(stepped, "labels")
        jump = stepped.select(F.col("node").alias("via"), F.col("at").alias("beyond"))
        jumped = written(stepped.join(jump, F.col("at") == F.col("via"), "left").select("node", "old", F.least("at", F.coalesce("beyond", "at")).alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
