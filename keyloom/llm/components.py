"""Connected components by label propagation with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """links (a, b), both long: (node, label) for each node that has a link, label being the smallest node it can reach.

    Labels only fall, and each round a node also takes its label's label, so even long chains end after few rounds. Minima per
    node are aggregated partially; no component is gathered anywhere.
    """
    edges = save(links.select("a", "b").union(links.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = save(labels, "labels")
    while True:
        heard = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        step = save(step, "labels-step")
        via = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = save(step.join(via, "label").select("node", "old", F.col("next").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            return labels
