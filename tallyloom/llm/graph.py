"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, hot_keys, join_hot


def components(edges: DataFrame) -> DataFrame:
    """(v, label): label is the least vertex that edges (a, b) reach from v, itself included.

    Each round takes the least label among the neighbours, then jumps to the label's
    own label. A hub is no hot key: minima have partial sums, and the labels of hubs
    are sent to their edges (``join_hot``). Rounds are few, since jumps double the
    distance covered; each ends in a checkpoint.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", both.count())
    labels = checkpoint(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = join_hot(both, labels.withColumnRenamed("v", "b"), "b", hot=hubs).groupBy("a").agg(F.min("label").alias("near"))
        least = checkpoint(labels.join(near, labels.v == near.a, "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        hop = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        moved = checkpoint(join_hot(least, hop, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("v", "label")
        if moved.where("old != label").isEmpty():
            return labels
