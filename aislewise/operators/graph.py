"""Connected components by lowest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.session import cut_lineage


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, node, label) with label = lowest node of the component.

    Nodes: (key, node).  Edges: (key, a, b), one direction is enough.  Every round takes the
    lowest neighbouring label and then the label of that label, so long chains halve.
    """
    both = edges.select(key, "a", "b").unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.filter("a <> b").distinct())
    labels = cut_lineage(nodes.select(key, "node", F.col("node").alias("label")))
    while True:  # labels only fall, so this ends
        offers = (
            both.join(labels.select(key, F.col("node").alias("b"), "label"), [key, "b"])
            .groupBy(key, F.col("a").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offers, [key, "node"], "left").select(
            key, "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        roots = lower.select(key, F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = cut_lineage(
            lower.join(roots, [key, "label"]).select(key, "node", "old", F.least("label", "root").alias("label"))
        )
        labels = jumped.drop("old")
        if jumped.filter("label < old").isEmpty():
            return labels
