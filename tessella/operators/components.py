"""Connected components of an edge table within keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.percentiles import matched
from tessella.sources.tables import release, stage


def components(edges: DataFrame, node: str, peer: str, *keys: str) -> DataFrame:
    """(keys, node, label): the least node of each connected group, for nodes with edges; keys may be null, loops are allowed.

    Each round takes the least label among a node's neighbours and then the label
    of that label, so paths shrink by half or more; no group is collected.
    """
    ends = [*keys, node]
    both = stage(edges.select(*keys, node, peer).unionByName(edges.select(*keys, F.col(peer).alias(node), F.col(node).alias(peer))).distinct(), "links")
    now = stage(both.groupBy(*ends).agg(F.least(F.col(node), F.min(peer)).alias("label")), "labels")
    while True:
        spread = matched(both, now.select(*keys, F.col(node).alias(peer), F.col("label").alias("_near")), [*keys, peer])
        least = matched(now, spread.groupBy(*ends).agg(F.min("_near").alias("_near")), ends)
        jump = matched(least.withColumn("_at", F.least("label", "_near")), now.select(*keys, F.col(node).alias("_at"), F.col("label").alias("_far")), [*keys, "_at"])
        after = stage(jump.select(*ends, F.least("_at", "_far").alias("label"), (F.least("_at", "_far") < F.col("label")).alias("_moved")), "labels")
        release(now)
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            release(both)
            return now
