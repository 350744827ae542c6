"""Connected components by label passing with pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b): label is the smallest node of the component.

    Each round every node takes the smallest label among itself and its neighbours, then the
    label of its label. Rounds are written to the shared folder; the number of rounds is about
    the logarithm of the longest path. A node with very many neighbours is no hot group: labels
    are joined to edges by sort-merge joins that Spark may split, and minima are pre-aggregated.
    """
    edges = save(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    held = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        labels = held.select("node", "label")
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = save(labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("low")), "labels")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = save(step.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("label"), F.col("label").alias("was")), "labels")
        discard(held, step)
        held = new
        if new.where("label <> was").isEmpty():
            discard(edges)
            return new.select("node", "label")
