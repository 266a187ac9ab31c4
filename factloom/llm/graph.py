"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node reachable.

    Each round gives a node the smallest label among its neighbours, then the label
    of its label, so long chains shrink by halves. Labels only ever sink and stay
    inside their component; rounds end when none changes. Nothing but the yes or
    no of that test reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = materialise(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = lower.join(root, "label").select("node", "old", F.least("label", "root").alias("label"))
        jumped = materialise(jumped, "labels")
        changed = bool(jumped.where(F.col("old") != F.col("label")).take(1))
        labels = jumped.select("node", "label")
        if not changed:
            return labels
