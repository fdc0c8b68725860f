"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import shared_dir, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b: whole numbers): the smallest node that each reaches.

    Every node points to a smaller one of its component. A round hooks pointers, and the
    pointers of pointers, to the smallest seen across an edge and then halves all paths,
    so rounds grow with the logarithm of the longest path. All steps are joins and
    minima with partial aggregation: a node with a third of all edges is no large group.
    Null ends and repeated edges add nothing; an empty table gives no rows.
    """
    folder = shared_dir(edges.sparkSession)
    own = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    both = staged(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
    up, turn = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).select(F.col("a").alias("node"), "up"), f"{folder}/up0"), 0
    while True:
        turn += 1
        far = staged(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up"), f"{folder}/far{turn}")
        across = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("seen")).join(far.select("node", "up"), "node")
        hooks = across.select(F.col("up").alias("node"), F.col("seen").alias("up")).unionByName(across.select("node", F.col("seen").alias("up"))).unionByName(far.select("node", F.col("far").alias("up")))
        new = staged(hooks.groupBy("node").agg(F.min("up").alias("up")), f"{folder}/up{turn}")
        if not new.join(up, ["node", "up"], "left_anti").head(1):
            return new.select("node", F.col("up").alias("component"))
        up = new
