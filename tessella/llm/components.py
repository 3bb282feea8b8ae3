"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.stage import release, save


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge; component is the least node of its component.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so paths shorten by half or more; every step is a join
    and a min that aggregates before it shuffles. Loops are allowed.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("peer"))
    both = save(both.union(both.select("peer", "node")).distinct(), "edges")
    labels = save(both.groupBy("node").agg(F.least("node", F.min("peer")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("peer"), "label"), "peer").select("node", "label")
        least = near.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = least.join(to, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = save(new, "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            release(both)
            return labels.withColumnRenamed("label", "component")
