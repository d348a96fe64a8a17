"""Connected components of a graph of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that ``links`` (a, b) reach from node.

    Every round lets each node point to its neighbour of least hash, if that is less than its own, and contracts the
    pointers. As hashes are in random order, a constant share of the nodes goes each round whatever the graph's shape,
    so the rounds grow with the logarithm of the input. Minima are combined before they are shuffled, which spares hot
    nodes. Links to itself and repeated links don't matter; nodes that no link names are not in the result.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = links.select("a", "b").where("a <> b").distinct()
    edges = scratch.table(edges, "links")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        up = least.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("parent"))
        up = scratch.table(up, "pointers")
        pointers.append(up)
        left = up.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = up.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        moved = scratch.table(moved.where("a <> b").distinct(), "links")
        scratch.drop(edges)
        edges = moved
    if not pointers:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    root = pointers[-1]
    for up in reversed(pointers[:-1]):
        after = root.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        root = up.join(after, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
    root = scratch.table(root, "roots")
    names = root.groupBy("parent").agg(F.min("node").alias("component"))
    out = scratch.table(root.join(names, "parent").select("node", "component"), "components")
    scratch.drop(root, edges, *pointers)
    return out
