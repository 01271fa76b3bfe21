"""Connected components of a graph that lies in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import persist_table


def _relabelled(edges: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """Edges between components; those inside one are gone."""
    one = labels.select(F.col("node").alias("_a"), F.col("component").alias("_ca"))
    two = labels.select(F.col("node").alias("_b"), F.col("component").alias("_cb"))
    return edges.join(one, edges[a] == F.col("_a")).join(two, F.col(b) == F.col("_b")).where("_ca <> _cb").select(
        F.greatest("_ca", "_cb").alias("high"), F.least("_ca", "_cb").alias("low")).distinct()


def connected(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Merges ``labels`` (node, component) along ``edges``; every component is named by its smallest former name.

    Each turn hooks every component to its smallest neighbour and shortens the
    hooks by pointer jumping, so at least half of the components that still
    have an edge disappear. Tables are written between steps: a lost executor
    costs one step.
    """
    while True:
        between = persist_table(_relabelled(edges, labels, a, b), "edges")
        if between.isEmpty():
            return labels
        hooks = persist_table(between.groupBy("high").agg(F.min("low").alias("to")), "hooks")
        while True:
            onward = hooks.select(F.col("high").alias("_high"), F.col("to").alias("_to"))
            jumped = persist_table(hooks.join(onward, hooks["to"] == F.col("_high"), "left").select(
                "high", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("high", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = persist_table(labels.join(hooks, labels["component"] == F.col("high"), "left").select(
            "node", F.coalesce("to", "component").alias("component")), "components")
