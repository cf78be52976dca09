"""Connected components of a bipartite graph of items and the keys they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finspark.session import cut


def components(edges: DataFrame, item: str = "item", key: str = "key", most_rounds: int = 60) -> DataFrame:
    """item, component: the smallest item that any chain of shared keys reaches.

    Keys are first turned into a star to their smallest item, so a key that a third of all items share
    costs one edge per item. Then labels spread and pointers jump until nothing changes; rounds grow with
    the logarithm of the longest chain. Every round is pre-aggregated and written to the checkpoint folder.

    Null items or keys are left out; an item without keys is no vertex; repeated edges count once.
    """
    e = edges.select(F.col(item).alias("i"), F.col(key).alias("k")).where("i is not null and k is not null").distinct()
    hub = e.groupBy("k").agg(F.min("i").alias("h"))
    star = e.join(hub, "k").select("i", "h").distinct()
    both = cut(star.select(F.col("i").alias("a"), F.col("h").alias("b")).unionAll(star.select(F.col("h").alias("a"), F.col("i").alias("b"))).where("a <> b").distinct())
    label = cut(e.select(F.col("i").alias("v")).distinct().withColumn("c", F.col("v")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        new = label.join(near, F.col("v") == F.col("a"), "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c"), F.col("c").alias("old"))
        jump = new.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = cut(new.join(jump, "c", "left").select("v", F.least("c", F.coalesce("j", "c")).alias("c"), "old"))
        if new.where("c <> old").isEmpty():
            return new.select(F.col("v").alias(item), F.col("c").alias("component"))
        label = new.select("v", "c")
    raise RuntimeError("components did not settle")
