"""Connected components over DataFrames of edges, without GraphFrames and without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.sources.scratch import materialize


def _contracted(edges: DataFrame, up: DataFrame) -> DataFrame:
    """Edges between the trees of a forest ``up(node, component)``, each once, from the greater root to the lesser."""
    high = edges.join(up.toDF("high", "a"), "high").select("a", "low")
    both = high.join(up.toDF("low", "b"), "low", "left").select("a", F.coalesce("b", "low").alias("b"))
    return both.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its least node.

    In every round each node points at its least neighbour, if that is less than itself; pointers are doubled until they
    end at roots, and only edges between different trees are kept, between their roots.  What is left shrinks quickly, so the rounds after the first cost little; the
    pointers of all rounds are put together in the end, the last round's first.  Each round is written to the shared folder; only one counter reaches the driver.  Minima are combined
    before each shuffle, so a hub costs no more than its edges.
    """
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    left = materialize(left.distinct(), "edges")
    forests: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.limit(1).count() == 0:
            break
        up = materialize(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component")), "labels")
        for _ in range(max_rounds):
            step = up.join(up.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
            step = materialize(step.select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), "labels")
            up = step.select("node", "component")
            if step.where("moved").limit(1).count() == 0:
                break
        else:
            raise RuntimeError(f"pointers did not settle in {max_rounds} rounds")
        forests.append(up)
        left = materialize(_contracted(left, up), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not forests:
        return left.select(F.col("high").alias("node"), F.col("low").alias("component"))
    labels = forests.pop()
    while forests:
        under = forests.pop().join(labels.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = materialize(under.unionByName(labels), "labels")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
