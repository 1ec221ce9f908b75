"""Connected components of an edge table by contraction, each round written to the shared
folder: every vertex goes to its smallest neighbour, edges are renamed and thinned out, until
none is left. Only edges of unequal ends survive a round, so work falls fast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex of ``edges`` (a, b); the label is the same over a
    component and one of its vertices. No edges give no rows."""
    left = common.written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent"))
        parents = common.checked_broadcast(common.written(parents, "parents"))
        if labels is None:
            labels = parents.select(F.col("a").alias("vertex"), F.col("parent").alias("label"))
        else:
            step = parents.select(F.col("a").alias("label"), "parent")
            labels = labels.join(step, "label", "left").select("vertex", F.coalesce("parent", "label").alias("label"))
        labels = common.written(labels, "labels")
        for end in ("a", "b"):
            left = left.join(parents.select(F.col("a").alias(end), "parent"), end).drop(end).withColumnRenamed("parent", end)
        left = common.written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    return labels if labels is not None else left.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
