"""Connected components for operators that split work into independent parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node of the component.

    Each round takes the smallest label next door, then the label of that label, so paths halve.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("next"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "next").alias("via"))
        jump = low.join(labels.select(F.col("node").alias("via"), F.col("label").alias("far")), "via", "left")
        new = written(jump.select("node", "was", F.least("via", "far").alias("label")), "labels")
        changed = not new.where("was <> label").isEmpty()
        labels = new.drop("was")
        if not changed:
            return labels
