"""Connected components as tables, for links that no driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.support import discard, written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, comp) for every node of ``edges`` (x, y): comp is the smallest node that links reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so a
    star needs one round and a chain about the logarithm of its length. Minima are combined before
    the shuffle, and every round is cut off as a written table."""
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jumped = low.alias("a").join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp").select("node", "old", F.least("comp", "up").alias("comp"))
        after = written(jumped, "labels")
        changed = after.filter("old <> comp").limit(1).count()
        discard(labels)
        labels = after.select("node", "comp")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(both)
    return labels
