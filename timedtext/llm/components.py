"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_tables


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``links`` (a, b) -> (node, component): every node that has a link, and the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so
    chains shorten by doubling. Labels are cut to a table per round. Nodes with very many links only
    meet partial minima and joins that Spark can split.
    """
    pairs = links.filter("a is not null and b is not null and a != b").select("a", "b")
    edges = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = held = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "cc-labels")
    for _ in range(most_rounds):
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = cut(labels.join(near, "node").select("node", F.least("component", "near").alias("low"), "component"), "cc-low")
        root = low.select(F.col("node").alias("low"), F.col("low").alias("root"))
        new = cut(low.join(root, "low").select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")), "cc-labels")
        drop_tables(low, held)
        moved = not new.filter("moved").isEmpty()
        labels, held = new.select("node", "component"), new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    drop_tables(edges)
    return labels
