"""Connected components of a link table, without gathering any node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut_in_loop


def _to_roots(tree: DataFrame) -> DataFrame:
    """``(node, parent)`` with each parent replaced by its root; the way to it halves with each step."""
    while True:
        above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
        jumped = tree.join(above, "parent", "left").select("node", F.coalesce("higher", "parent").alias("parent"), F.col("higher").isNotNull().alias("moved"))
        jumped = cut_in_loop(jumped)
        tree = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round hangs every node under its smallest neighbour of smaller id, looks up the roots of these
    trees, and goes on with links between roots. What is left after a round are nodes without a smaller
    neighbour; of those that a hung node had, all but one get a smaller neighbour by it and hang
    in the next round. So two rounds halve the nodes that still have links at least, and there are
    ``2 log2(n)`` rounds at most, each of the logarithm of its trees' depth. Only minima are aggregated, so
    a node with very many links costs its links, spread by their other ends. Loops and repeated links do
    no harm. The smallest node of a component never hangs, so it is the root.
    """
    edges = cut_in_loop(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).where("node > to").distinct())
    trees = []
    while True:
        lowest = cut_in_loop(edges.groupBy("node").agg(F.min("to").alias("parent"), F.count("*").alias("n")))
        tree = lowest.select("node", "parent")
        if lowest.where("n > 1").isEmpty():
            trees.append(tree)
            break
        tree = _to_roots(tree)
        trees.append(tree)
        there = edges.join(tree, "node").select(F.col("parent").alias("a"), F.col("to").alias("node")).join(tree, "node", "left").select("a", F.coalesce("parent", "node").alias("b"))
        edges = cut_in_loop(there.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).where("node > to").distinct())
    forest = trees[0]
    for tree in trees[1:]:
        forest = forest.unionByName(tree)
    tree = _to_roots(forest)
    roots = tree.select(F.col("parent").alias("node")).distinct().withColumn("component", F.col("node"))
    return tree.withColumnRenamed("parent", "component").unionByName(roots)
