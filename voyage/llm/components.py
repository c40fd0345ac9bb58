"""Connected components of an edge table by least labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that links reach.

    Each round takes the least label among neighbours, then the label of that label, so chains halve from round to round.
    Every round is a written table. No edges: no rows. Null ends are left out; repeated edges and loops change nothing.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        step = written(step.join(jump, "up", "left").select("node", "old", F.least("up", "top").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
