"""Connected components without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b), component being its smallest node.

    Smallest labels spread over the links, then labels of labels are taken, until nothing changes: about log
    of the longest path rounds, each a few aggregations with map-side combining, cut by a checkpoint.
    Loops and repeated links do no harm; links with a null end are left out; no links give no rows.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels.node == near.a, "left").select("node", F.least("component", "near").alias("new"), "component")
        jump = spread.select(F.col("node").alias("at"), F.col("new").alias("further"))
        new = cut(spread.join(jump, F.col("new") == F.col("at"), "left").select("node", F.least("new", "further").alias("new"), "component"))
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels
