"""Connected components by contraction, as joins: nothing about the graph is collected on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b; integers).

    Each round hangs every node below its smallest neighbour, shortens these paths to their ends by doubling, and
    contracts the edges; a star goes in one round, and rounds are logarithmic in the longest path of ascending nodes.

    Defined cases: repeated edges count once, edges from a node to itself and edges with a null end not at all, so a
    node that has only such edges has no row; no edges give no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            longer = materialise(up.join(above, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            up = longer.select("u", "p")
            if longer.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(up.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = materialise(labels)
        a, b = up.select(F.col("u").alias("a"), F.col("p").alias("x")), up.select(F.col("u").alias("b"), F.col("p").alias("y"))
        edges = materialise(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    forget(edges.sparkSession)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
