"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label): each node that has an edge, with the smallest node that it reaches.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so that
    paths shorten by half or more. The rounds end when no label changes. Rows whose ends are null are no edges;
    loops, repeated and reversed edges do no harm; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("near"))
    both = scratch.keep(both.union(both.select("near", "node")).filter("node is not null and near is not null").distinct())
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("seen"))
        nearer = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = scratch.keep(nearer.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")))
        scratch.drop(labels)
        labels = after
        if after.filter("old <> label").isEmpty():
            scratch.drop(both)
            return labels.select("node", "label")
