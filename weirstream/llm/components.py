"""Connected components over link tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (node, parent; parent < node) to the roots, doubling the step each time."""
    while True:
        nxt = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = staged(parents.join(nxt, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "roots")
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b: longs); the component is its least node.

    Each round hooks every node to its least smaller neighbour, follows the
    hooks to their roots and puts roots in the nodes' place; the links left
    between different roots are the next round's. Rounds and steps grow with the
    logarithm of the longest path. All tables stay distributed.
    """
    links = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    spark = links.sparkSession
    labels = spark.createDataFrame([], "node long, component long")
    first = True
    while not links.isEmpty():
        roots = _roots(staged(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "parents"))
        if first:
            every = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
            labels = every.join(roots, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
            first = False
        else:
            moved = roots.select(F.col("node").alias("component"), "parent")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = staged(labels, "labels")
        to = lambda c: roots.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        mapped = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        links = staged(mapped.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return labels
