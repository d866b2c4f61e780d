"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.storage import Table


def components(edges: DataFrame) -> DataFrame:
    """id, label for each id in ``edges`` (a, b): the smallest id of its component.

    Each round takes the smallest label among an id and its neighbours, then that label's own label, so long chains
    shrink by half. Every round is written to the shared folder, and the one before it deleted; only a count reaches the driver.
    """
    both = Table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a != b").distinct())
    held = Table(both.df.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        labels = held.df.select("id", "label")
        near = both.df.join(labels, both.df["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", F.least("label", "near").alias("up"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("up"), F.col("label").alias("over"))
        new = Table(least.join(jump, "up", "left").select("id", F.least("up", F.coalesce("over", "up")).alias("label"), "old"))
        changed = new.df.filter("label != old").limit(1).count()
        held.drop()
        held = new
        if not changed:
            both.drop()
            return held.df.select("id", "label")
