"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached from each node of ``edges(a, b)``.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shrink by half. Only minima are
    aggregated: a node with very many links sends one row per task. No links
    give no rows; repeated links and links to itself change nothing.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                         .select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        moved = cut_lineage(met.join(jump, "to").select("node", "label", F.least("to", "next").alias("new")))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter("new <> label").isEmpty():
            return labels
