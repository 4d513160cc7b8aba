"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrove.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) from links (a, b): the smallest node that each node of a link can reach.

    Every round takes the smallest label of the neighbours and then the label of that label, so chains halve. The
    state is written in every round; only the number of changed rows reaches the driver.
    """
    forward = links.select("a", "b")
    both = materialize(forward.union(forward.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = materialize(lower.join(jump, "component").select(
            "node", "before", F.least("component", "further").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("before <> component").isEmpty():
            return labels
