"""Connected components of a link table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b), the component being its smallest node; nodes
    are of any type that has an order.

    Each round every node takes the smallest of itself and its neighbours as parent, parents
    are followed once more, and links are rewritten to parents; those within one parent go.
    A path of n links thus shrinks by a factor in each round. Every round is written to the
    shared folder. Null ends and loops are left out.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent"))
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        parent = cut(parent.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent")), "parents")
        if label is None:
            label = parent.select("node", F.col("parent").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            label = cut(label.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").where("pa <> pb")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
