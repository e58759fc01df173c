"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of `edges`: a, b.

    Every node takes its neighbours' least label, then its label's label, until nothing changes; the second step halves
    the way to the least node each time. Rounds are written down, so a lost executor costs one round at most. Loops and
    repeated edges don't matter, rows with a null end are left out; no edges, no rows.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = written(edges.union(edges.select("b", "a")).distinct(), "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        of = labels.select(F.col("node").alias("mid"), F.col("label").alias("next"))
        stepped = stepped.join(of, "mid").select("node", "old", F.least("mid", "next").alias("label"))
        stepped = written(stepped, "labels")
        labels = stepped.select("node", "label")
        if stepped.where(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")
