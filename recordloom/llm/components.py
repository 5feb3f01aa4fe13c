"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the smallest node of its component.

    Each round every node hooks on to its smallest neighbour, pointers are shortened, and the edges are
    rewritten between what is left, so the edge table shrinks round by round.  Each round writes a table to the
    shared folder.  An edge from a node to itself keeps that node alone.
    """
    edges = materialise(edges.select("u", "v").distinct(), "cc-edges")
    labels = materialise(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
                         .withColumn("label", F.col("node")), "cc-labels")
    while True:
        live = edges.where("u <> v")
        if live.isEmpty():
            return labels
        both = live.union(live.select("v", "u"))
        hooks = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_least")).select(
            "node", F.least("node", "_least").alias("parent"))
        hooks = materialise(shorten(shorten(hooks)), "cc-hooks")
        labels = materialise(follow(labels, hooks, "label"), "cc-labels")
        edges = materialise(follow(follow(edges, hooks, "u"), hooks, "v").where("u <> v").distinct(), "cc-edges")


def shorten(hooks: DataFrame) -> DataFrame:
    return follow(hooks, hooks, "parent")


def follow(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by what it hooks on to."""
    step = hooks.select(F.col("node").alias("_from"), F.col("parent").alias("_to"))
    return rows.join(step, F.col(column) == F.col("_from"), "left").withColumn(
        column, F.coalesce("_to", column)).drop("_from", "_to")
