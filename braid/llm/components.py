"""Connected components of an edge table, by least labels and pointer jumping over written tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node that it reaches.

    A round takes the least label among a node's neighbours, then the label of that label, so a path of n edges takes about
    log n rounds. All rounds are joins and map-side combined minima of tables in the shared folder; only whether anything
    changed comes to the driver. Self-loops and repeated edges don't matter; an empty table gives an empty result.
    """
    links = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        dropped(labels)
        labels = written(lower.join(up, "label").select("node", F.col("above").alias("label"), "old"), "labels")
        dropped(lower)
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        path, labels = labels._braid_path, labels.select("node", "label")
        labels._braid_path = path
