"""Connected components as joins: hook every root to its smallest neighbour, compress, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize


def _compressed(parent: DataFrame) -> DataFrame:
    """Follow (node, up) until every node points at a root; up < node, so there is no cycle."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("top").isNotNull() & (F.col("top") != F.col("up"))).alias("moved"))
        step = materialize(step, "cc-jump")
        parent = step.select("node", "up")
        if step.filter("moved").isEmpty():
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (src, dst); root is the smallest node of its component.

    Nulls in src or dst are ignored, self-loops and repeated edges are harmless, an empty input gives no rows. Every
    round writes its tables to the shared folder; nothing but an emptiness test reaches the driver.
    """
    edges = edges.filter("src is not null and dst is not null")
    live = materialize(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        # Every node but the smallest of its neighbourhood hooks to a smaller one.
        low = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        roots = live.select(F.col("a").alias("node")).distinct().join(low, "node", "left_anti").select("node", F.col("node").alias("up"))
        parent = _compressed(low.unionByName(roots))
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            labels = labels.join(parent.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = materialize(labels, "cc-labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ra")), parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        live = live.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live = materialize(live, "cc-edges")
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    return labels
