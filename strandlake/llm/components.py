"""Connected components of a link table: every node takes the least label around it, then its label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandlake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (a, b); label is the least node of the component.

    The number of rounds grows with the logarithm of a component's width; no node's links are gathered in one place,
    only their minimum, which is taken before the shuffle as well.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = (labels.join(heard, labels["node"] == heard["a"])
                 .select("node", F.col("label").alias("was"), F.least("label", "heard").alias("low")))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        nxt = materialize(lower.join(up, "low", "left").select("node", "was", F.least("low", F.coalesce("up", "low")).alias("label")), "labels")
        changed = nxt.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
