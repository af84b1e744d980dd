"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm.common import discard, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has long columns a and b; gives node and component, its smallest reachable node.

    Labels move along links and then jump to their label's label, so rounds follow the logarithm of a
    component's width. Sums over a node's links are combined before the shuffle and joins can be split,
    so a node with very many links meets no single task. Each round is a table in the
    shared folder, as is the result; earlier ones are removed. Self links are allowed; no links give no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    last = labels
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = stored(hooked.join(up, "component").select("node", "was", F.least("component", "above").alias("component")))
        discard(last)
        labels, last = moved.select("node", "component"), moved
        if moved.where("was <> component").limit(1).count() == 0:
            discard(both)
            labels.stored_at = moved.stored_at
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
