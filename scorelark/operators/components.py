"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for edges (a, b); labels spread over edges and jump over themselves.

    Each round is written, so lineage stays short.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    first = True
    while True:
        label = written(label, "labels") if first else label
        first = False
        of = label.select(F.col("node").alias("b"), F.col("component").alias("near"))
        spread = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nearer = label.join(spread, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        # a label's own label is nearer still
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(nearer.join(jump, "component").select("node", F.least("component", "further").alias("component"), "old"), "labels")
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return label
