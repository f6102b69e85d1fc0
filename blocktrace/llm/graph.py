"""Connected components of a table of links, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of `links` (`a`, `b`).

    Returns `node`, `component`. Every round takes the smallest label among the
    neighbours, then the label's own label, so long chains shorten quickly.
    Null ends are dropped; no links give no rows.
    """
    links = links.select("a", "b").dropna()
    edges = settle(links.union(links.select("b", "a")).distinct(), "edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low"))
                    .select("node", F.least("node", "_low").alias("component")), "labels")
    while True:
        offers = (edges.join(labels, edges["b"] == labels["node"])
                  .groupBy(F.col("a").alias("_node")).agg(F.min("component").alias("_offer")))
        nearer = labels.join(offers, labels["node"] == offers["_node"]).select(
            "node", F.col("component").alias("_before"), F.least("component", "_offer").alias("_label"))
        jumps = labels.select(F.col("node").alias("_node"), F.col("component").alias("_jump"))
        after = settle(nearer.join(jumps, F.col("_label") == F.col("_node")).select(
            "node", "_before", F.least("_label", "_jump").alias("component")), "labels")
        if after.filter("component < _before").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
