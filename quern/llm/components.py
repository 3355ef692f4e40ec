"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, release, written


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` reaches.

    Minimum labels with hooking: in each round a node takes the smallest of its neighbours' grandparents,
    hands it on to its own parent as well, and jumps to its grandparent. Trees therefore merge at their
    roots, and the rounds grow with the logarithm of a chain's length (18 for 100,000 nodes), in whatever
    order its nodes are numbered. All sums are minima, combined before the shuffle, so hot nodes don't
    hurt. Labels are written each round and the round before is deleted; links stay distributed. The loop
    ends when no label changes, and as labels only fall, it does end. After ``rounds`` of them, if given,
    nodes with the same label are connected, but those of one component may still have several.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    # node, its label up, and its label's label top
    first = F.min(F.least("a", "b"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(first.alias("up")).withColumn("top", F.col("up")), "labels")
    if labels.isEmpty():
        release(both)
        return as_table(labels.select("node", F.col("up").alias("component")), labels)
    done = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("near"))
        near = labels.join(near, "node")
        hook = near.groupBy(F.col("up").alias("node")).agg(F.min("near").alias("hook"))
        step = near.join(hook, "node", "left").select("node", "up", "top", F.least("top", "near", F.coalesce("hook", "top")).alias("new"))
        step = written(step, "labels")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("next"))
        jumped = step.join(jump, "new", "left").select("node", F.col("new").alias("up"), F.coalesce("next", "new").alias("top"), (F.col("up") != F.col("new")).alias("moved"), F.col("top").alias("was"))
        jumped = written(jumped, "labels")
        release(step, labels)
        labels, done = jumped, done + 1
        if done == rounds or jumped.where(F.col("moved") | (F.col("was") != F.col("top"))).isEmpty():
            release(both)
            return as_table(jumped.select("node", F.col("top").alias("component")), jumped)
