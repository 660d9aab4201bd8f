"""Citation networks: search path counts over a directed graph without cycles, and the main path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.tables import checkpointed

COUNT = "decimal(38,0)"


def _walk(edges: DataFrame) -> DataFrame:
    """node, n, level: for every node that no cycle leads to, the paths to it from nodes without an edge to them, and the longest one's length.

    A node is settled in the round in which the last of the edges to it has come; every round is checkpointed and follows
    only the edges of the nodes settled before it.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    degree = checkpointed(nodes.join(edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node", "left").na.fill(0, ["degree"]))
    front = degree.where("degree = 0").select("node", F.lit(1).cast(COUNT).alias("n"), F.lit(0).alias("level"))
    pending, settled = None, None
    while True:
        front = checkpointed(front)
        if front.isEmpty():
            return settled if settled is not None else front
        settled = front if settled is None else settled.unionByName(front)
        here = edges.join(front.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum("n").cast(COUNT).alias("n"), F.count(F.lit(1)).alias("came"), F.max("level").alias("level"))
        if pending is not None:
            here = pending.unionByName(here).groupBy("node").agg(F.sum("n").cast(COUNT).alias("n"), F.sum("came").alias("came"), F.max("level").alias("level"))
        here = checkpointed(here.join(degree, "node"))
        front = here.where("came = degree").select("node", "n", (F.col("level") + 1).alias("level"))
        pending = here.where("came < degree").select("node", "n", "came", "level")


def path_counts(edges: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """((source, target, weight), (node)): how many paths from a beginning to an end go over each edge, and the nodes that lie on a cycle or
    between cycles, whose edges have no count.

    Repeated edges are one, edges from a node to itself or with a null are no edges.  Counts are exact up to 38 digits.
    """
    plain = checkpointed(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a != b").distinct())
    ahead, back = _walk(plain), _walk(plain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = plain.select(F.col("a").alias("node")).union(plain.select("b")).distinct()
    tangled = checkpointed(nodes.join(ahead, "node", "left_anti").join(back, "node", "left_anti"))
    counted = plain.join(ahead.select(F.col("node").alias("a"), F.col("n").alias("into"), "level"), "a").join(back.select(F.col("node").alias("b"), F.col("n").alias("out")), "b")
    weights = counted.select(F.col("a").alias(source), F.col("b").alias(target), (F.col("into") * F.col("out")).cast(COUNT).alias("weight"), "level")
    return weights, tangled.select("node")


def main_path(weights: DataFrame, source: str, target: str) -> DataFrame:
    """step, source, target, weight: from the heaviest edge that begins at level 0 along the heaviest edge of each node.

    Ties go to the smallest target, at the beginning to the smallest source.  A round per step moves one row.
    """
    best = weights.groupBy(source).agg(F.max("weight").alias("weight"))
    edges = checkpointed(weights.join(best, [source, "weight"]).groupBy(source, "weight", "level").agg(F.min(target).alias(target)))
    at = edges.where("level = 0").orderBy(F.desc("weight"), source).limit(1).select(F.lit(0).alias("step"), source, target, "weight")
    out = at = checkpointed(at)
    while not at.isEmpty():
        step = at.select((F.col("step") + 1).alias("step"), F.col(target).alias(source))
        at = checkpointed(edges.join(F.broadcast(step), source).select("step", source, target, "weight"))
        out = out.unionByName(at)
    return out
