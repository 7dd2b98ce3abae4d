"""Connected components over an edge table, by contraction along least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, label) for the nodes of `edges` (a, b): label is the least node of the component.

    Each round ties every node to its least neighbour, follows these ties to their end, and contracts the edges:
    both ends are named anew, loops and doubles go. So the edges are joined in full in the first round only, and few
    are left after it. Lineage is cut in each round. Nothing but whether edges are left reaches the driver.
    """
    ends = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = common.checkpointed(ends.distinct())
    labels = None
    for _ in range(most):
        if left.isEmpty():
            return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
        below = left.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("up"))
        alone = left.groupBy(F.col("a").alias("x")).agg(F.min("a").alias("up"))  # no neighbour is less, unless `below` has one
        ties = common.checkpointed(below.union(alone).groupBy("x").agg(F.min("up").alias("up")))
        for _ in range(most):  # doubling: after k steps a node points 2^k ties on, at last to the least of its tree
            further = ties.select(F.col("x").alias("at"), F.col("up").alias("next"))
            doubled = common.checkpointed(ties.join(further, ties["up"] == further["at"]).select("x", "up", "next"))
            ties = doubled.select("x", F.col("next").alias("up"))
            if doubled.filter("next <> up").isEmpty():
                break
        if labels is None:
            labels = ties.select(F.col("x").alias("node"), F.col("up").alias("label"))
        else:
            moved = labels.join(ties, labels["label"] == ties["x"], "left")
            labels = common.checkpointed(moved.select("node", F.coalesce("up", "label").alias("label")))
        first, second = ties.toDF("a", "la"), ties.toDF("b", "lb")
        renamed = left.join(first, "a").join(second, "b").filter("la <> lb")
        left = common.checkpointed(renamed.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")
