"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges' ends, the component being its least node. Edges: (a, b).

    Each round a node takes the least label among itself, its neighbours and its label's label, so long chains halve; labels only
    fall, so rounds end. Every round is written to the shared folder; only the number of changes comes to the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node <> other")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        step = step.join(labels.select(F.col("node").alias("new"), F.col("component").alias("beyond")), "new", "left")
        step = written(step.select("node", "old", F.least("new", F.coalesce("beyond", "new")).alias("component")), "labels")
        dropped(labels)
        labels = step
        if not step.where(F.col("component") < F.col("old")).limit(1).count():
            dropped(both)
            out = step.select("node", "component")
            out.written_at = step.written_at
            return out
