"""Connected components by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


SMALL = 200_000  # rows of a few numbers that may be broadcast (a few MB); more are shuffled


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table with the hint to broadcast it, if it is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each end of an edge (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that label, so paths
    shorten by half and more; minima are combined before the shuffle. Rounds end when nothing
    changes. Labels are written to the shared folder each round."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(
        "a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        known = small(labels)
        offers = both.join(known.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(False).alias("own"))
        hooked = offers.unionByName(labels.withColumn("own", F.lit(True))).groupBy("node").agg(
            F.min("label").alias("label"), F.min(F.when(F.col("own"), F.col("label"))).alias("old"))
        jump = known.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = cut_lineage(hooked.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        changed = after.filter("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
