"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import drop, materialize


def components(links: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """(node, label) for every node of ``links`` (a, b): label is the least node reachable. And the table's path.

    Rounds of hooking (a node, and its label, take the least label next to them) and pointer jumping. The minimum over
    neighbours is combined before the shuffle and joins on hubs can be split, so a star of any size is no hot group.
    Each round is a table in the shared folder.
    """
    spark = links.sparkSession
    both, both_path = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{tag}-links")
    labels, path = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{tag}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        offers = hooked.select("node", F.col("new").alias("offer")).union(hooked.where("new < label").select(F.col("label").alias("node"), F.col("new").alias("offer"))).groupBy("node").agg(F.min("offer").alias("offer"))
        jumped = offers.alias("x").join(offers.select(F.col("node").alias("offer"), F.col("offer").alias("far")), "offer", "left").select("node", F.least("offer", F.coalesce("far", "offer")).alias("label"))
        now, now_path = materialize(jumped, f"{tag}-labels")
        changed = now.select("node", F.col("label").alias("new")).join(labels, "node").where("new <> label").isEmpty()
        drop(spark, path)
        labels, path = now, now_path
        if changed:
            drop(spark, both_path)
            return labels, path
