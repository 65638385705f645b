"""Connected components of a graph of links, by repeated minima and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import staged


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its least node.

    Each round takes the least label among a node and its neighbours and then the label of that
    label, so the distance to the least node at least halves; stars take two rounds. Nothing
    but the count of changes reaches the driver. Links to itself or repeated do no harm.
    """
    both = staged(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(spark, both.groupBy(F.col("a").alias("node")).agg(
        F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = staged(spark, labels.join(near, "node").select(
            "node", F.col("component").alias("old"),
            F.least("component", "near").alias("label")), "nearer")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("component"))
        jumped = staged(spark, nearer.join(jump, "label").select(
            "node", "component", (F.col("component") != F.col("old")).alias("changed")), "labels")
        changed = jumped.where("changed").limit(1).count()
        labels = jumped.drop("changed")
        if not changed:
            return labels
