"""Connected components over links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component is the smallest node reachable.

    Each round takes the smallest label among neighbours, then jumps from labels to labels of labels,
    so long chains close in logarithmically many rounds.  Both sides combine partially before the shuffle.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("l"))
    label = stored(label)
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, label.node == near.a).select("node", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        step = stored(step)
        up = step.select(F.col("node").alias("u"), F.col("l").alias("ul"))
        jumped = stored(step.join(up, step.l == up.u, "left").select("node", F.least("l", F.coalesce("ul", "l")).alias("l"), "was"))
        label = jumped.select("node", "l")
        if jumped.where("l <> was").isEmpty():
            return label.select("node", F.col("l").alias("component"))
