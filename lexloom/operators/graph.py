"""Components of a small graph of spelling pairs by propagating least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.store import kept


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable; edges have a and b.

    A round takes the least label of the neighbours, then the label of that label, until no label changes; every round is checkpointed.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = kept(e.union(e.select("b", "a")).distinct())
    label = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hop = label.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("via"))
        jump = hop.join(label.select(F.col("node").alias("via"), F.col("root").alias("far")), "via")
        now = kept(jump.select("node", F.least("via", "far").alias("root"), (F.least("via", "far") < F.col("before")).alias("moved")))
        label = now.select("node", "root")
        if not now.where("moved").take(1):
            return label
