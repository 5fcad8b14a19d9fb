"""Connected components by label propagation with pointer jumping; no group of edges is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of every node of ``edges`` (a, b).

    Each round takes the least label among the neighbours and then the label's own label, so that long chains
    shorten fast. Both sides of every join are tables, so that adaptive execution can split a hub's edges. The tables
    of a round go with the next.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = last = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        least = cut(labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        of = least.select(F.col("node").alias("of"), F.col("label").alias("next"))
        jumped = cut(least.join(of, F.col("label") == F.col("of")).select("node", F.least("label", "next").alias("label"), "was"))
        changed = jumped.where("label <> was").limit(1).count()
        drop(least, last)
        labels, last = jumped.select("node", "label"), jumped
        if not changed:
            drop(both)
            return labels
