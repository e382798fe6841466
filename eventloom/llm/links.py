"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import broadcast_if_small, durable, parts_for, stored_bytes

#: The largest table of labels that is copied to every executor, in bytes; larger ones are shuffled.
LABELS = 8 << 20


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of the links ``(a, b)``; the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so the number of rounds follows the logarithm of the longest
    chain. Rounds go on until no label falls. Sums and minima are combined before
    the shuffle; a node with very many links is split by adaptive execution. Links and
    labels are kept in as many partitions as their measured size needs.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # There are no more labels than links in both directions.
    size = stored_bytes(both)
    parts = parts_for(size)
    both = both.coalesce(parts)
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")).coalesce(parts))
    while True:
        of = broadcast_if_small(labels.select(F.col("node").alias("b"), "label"), LABELS, size)
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = broadcast_if_small(labels, LABELS, size)
        lower = near.join(own, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        roots = broadcast_if_small(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), LABELS, size)
        jumped = durable(lower.join(roots, "label").select("node", F.least("label", "root").alias("label"), "was").coalesce(parts))
        labels = jumped.select("node", "label")
        if jumped.where("label < was").isEmpty():
            return labels
