"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrika.llm.common import release, stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b): the smallest node it is connected with.

    Each round takes the smallest label among neighbours, then follows labels twice, so chains
    shrink to about a third or less. Rounds are stored, each until the next one is, and the caller may
    ``release`` the result; a hub's links are summed up before they
    move, and joins with a hub may be split by adaptive execution.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        for _ in range(2):
            jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
            lower = lower.join(jump, lower["label"] == jump["at"], "left").select(
                "node", "was", F.least("label", "to").alias("label")
            )
        lower = stored(lower, "labels")
        release(labels)
        done = lower.where("label <> was").isEmpty()
        labels = lower.select("node", "label")
        labels.stored_path = lower.stored_path
        if done:
            release(both)
            return labels
