"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: src, dst (long). Returns node, component (the component's smallest node) for each node with an edge.

    A round takes each node's smallest neighbouring label, then follows labels one step further, so chains with ids in order take a
    logarithmic number of rounds, others up to their length. Each round is checkpointed; only a flag reaches the driver. Joins on labels are plain
    sort-merge joins between checkpointed frames, which adaptive execution can split where one component is large.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = checkpointed(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = checkpointed(step.join(jump, "label").select("node", F.col("further").alias("label"), "old"))
        if labels.where("label != old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
