"""Connected components of a link table by joins, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(class, component) for every end of ``links`` (a, b): the smallest class it is connected with.

    Each round takes the smallest label among neighbours, then jumps to that
    label's own label, so the rounds grow with the logarithm of a component's
    width. Every round is written to the checkpoint folder, and counts on the way
    what it changed.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), small=True)
    labels = cut(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("component")), small=True)
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "class", "left").select("class", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = lower.select(F.col("class").alias("component"), F.col("component").alias("root"))
        changed = Observation()
        after = lower.join(jump, "component", "left").select("class", F.least("component", "root").alias("component"), "before")
        labels = cut(after.observe(changed, F.count_if(F.col("component") != F.col("before")).alias("n")), small=True).select("class", "component")
        if not changed.get["n"]:
            return labels
    raise RuntimeError("components did not settle")
