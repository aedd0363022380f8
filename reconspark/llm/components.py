"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links(a, b): undirected. Returns (node, label) for every node of a link; label is the least node reachable.

    A round takes the least label among a node's neighbours and then the label of that label, so long chains
    shrink geometrically. Labels live in written tables; only the count of changed labels reaches the driver. Joins
    read two written tables each, so adaptive execution can split a label that many nodes hold.
    No links: an empty table.
    """
    links = links.select("a", "b").where("a <> b")
    both = scratch.save(links.union(links.select("b", "a")).distinct(), "links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.withColumnsRenamed({"node": "b", "label": "theirs"}), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        step = scratch.save(labels.join(least, "node").select("node", "label", F.least("label", "theirs").alias("next")), f"step-{turn}")
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = step.join(up, "next", "left").select("node", F.coalesce(F.least("next", "beyond"), "next").alias("label"), F.col("label").alias("old"))
        new = scratch.save(new, f"labels-{turn}")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(f"labels-{turn - 1}")
        scratch.drop(f"step-{turn}")
        labels = new.select("node", "label")
        if not changed:
            return labels
