"""Connected components of a link table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then the label of
    that label, so that the rounds grow with the logarithm of the longest path. Labels are written as a
    table every round; the driver sees one count. A hub's links are split by AQE in the join and
    combined on the map side in the minimum.
    """
    both = checkpointed(
        links.select(F.col(left).alias("_from"), F.col(right).alias("_to"))
        .unionByName(links.select(F.col(right).alias("_from"), F.col(left).alias("_to")))
        .where(F.col("_from") != F.col("_to"))
        .distinct()
    )
    labels = checkpointed(
        both.groupBy(F.col("_from").alias("node")).agg(
            F.least(F.min("_to"), F.min("_from")).alias("component")
        )
    )
    while True:
        near = (
            both.join(labels, F.col("_to") == F.col("node"))
            .groupBy(F.col("_from").alias("_near"))
            .agg(F.min("component").alias("_least"))
        )
        lower = checkpointed(
            labels.join(near, F.col("node") == F.col("_near")).select(
                "node",
                F.col("component").alias("_before"),
                F.least("component", "_least").alias("_lower"),
            )
        )
        jump = lower.select(F.col("node").alias("_at"), F.col("_lower").alias("_jumped"))
        labels = checkpointed(
            lower.join(jump, F.col("_lower") == F.col("_at")).select(
                "node", F.col("_jumped").alias("component"), "_before"
            )
        )
        changed = labels.where(F.col("component") != F.col("_before")).count()
        labels = labels.select("node", "component")
        if not changed:
            return labels
