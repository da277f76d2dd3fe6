"""Connected components of links, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it reaches, of undirected links (a, b).

    Each step takes the least label of the neighbours and then jumps to the
    label's label; what has not settled is all that decides on another step.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "far")
        settled = written(step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if settled.where("label <> old").isEmpty():
            return settled.select("node", "label")
        labels = settled.select("node", "label")
