"""Connected components of an undirected graph.

Every node carries the smallest node it knows (a label).  A round lowers labels along edges
and then jumps: a node takes the label of its label.  Long chains thus close in a logarithmic
number of rounds.  Rounds are written tables; only the number of changed nodes reaches the
driver.

Defined results: edges with a null end are none; loops make a node of their own; repeated and
reversed edges change nothing; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, load, materialize, store_counting


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node of its component."""
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = materialize(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    start = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label"), F.lit(True).alias("moved"))
    path, n = store_counting(start, "labels", moved="moved")
    state = load(spark, path, start)
    while n["moved"]:
        labels = state.select("node", "label")
        # neighbours' labels; a node is told by those that moved only
        told = both.join(state.where("moved").select(F.col("node").alias("y"), F.col("label").alias("near")), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(told, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        of_label = lower.select(F.col("node").alias("l_node"), F.col("low").alias("jump"))
        after = lower.join(of_label, F.col("low") == F.col("l_node"), "left").select("node", F.least("low", "jump").alias("new"), "label")
        before = path
        path, n = store_counting(after.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels", moved="moved")
        discard(spark, before)
        state = load(spark, path, start)
    return state.select("node", F.col("label").alias("component"))
