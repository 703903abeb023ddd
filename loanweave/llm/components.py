"""Connected components of a table of links, as DataFrame rounds.

Each round every node takes the smallest label among its own and its neighbours', then the label
of its label (pointer jumping), so chains shrink by more than half a round. Labels are stored
after every round in the shared folder; nothing but a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.store import drop, stored


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of a link (a, b); a
    working table of its own (column moved: of no use) that the caller may drop."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        moved = low.join(up, F.col("low") == F.col("up"), "left").select(
            "node", F.least("low", F.coalesce("upper", "low")).alias("label"),
            (F.least("low", F.coalesce("upper", "low")) != F.col("label")).alias("moved"))
        moved = stored(moved, "labels")
        drop(labels)
        labels = moved
        if not moved.where("moved").limit(1).count():
            drop(both)
            return moved
