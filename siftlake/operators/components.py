"""Connected components by label propagation with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, a: str, b: str, checkpointed: Callable[[DataFrame], DataFrame], most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node that it can reach.

    Each round gives a node the least label among its neighbours, then the label of its label, so labels run along
    chains in a logarithm of their length; `checkpointed` cuts the lineage and must be safe against lost executors.
    Edges with a null end are ignored; loops and repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    both = checkpointed(pairs.unionAll(pairs.select("v", "u")).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("v"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        over = lower.select(F.col("node").alias("p"), F.col("component").alias("above"))
        new = checkpointed(lower.join(over, F.col("component") == F.col("p"), "left").select("node", "old", F.least("component", "above").alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components still changed after {most_rounds} rounds")
