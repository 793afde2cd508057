"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Every round leaves at most half of the names that still have edges; this is far beyond.
ROUNDS = 100


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks (node, up) to the end of their chains; a chain of n hooks takes log n doublings."""
    while True:
        over = hooks.select(F.col("node").alias("up"), F.col("up").alias("end"))
        longer = hooks.join(over, "up", "left")
        if longer.filter("end is not null").isEmpty():
            return hooks
        hooks = checkpoint(longer.select("node", F.coalesce("end", "up").alias("up")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component.

    Each round hooks every vertex to its smallest neighbour, if that is smaller, follows the hooks to their ends by doubling, and renames
    the ends of all edges. Two nodes of an edge always have the same name or names joined by an edge, so the names are right once no
    edge is left. Loops, repeated edges and null ends are ignored. All state stays in checkpoints of the shared folder; hubs only meet in
    partial minima and in joins of two plain exchanges, which Spark can split.
    """
    live = checkpoint(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x < y").distinct())
    steps: list[DataFrame] = []
    first = live
    for _ in range(ROUNDS):
        if live.isEmpty():
            break
        hooks = _followed(checkpoint(live.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("up"))))
        steps.append(hooks)
        named = live.join(hooks.select(F.col("node").alias("y"), F.col("up").alias("new_y")), "y")
        named = named.join(hooks.select(F.col("node").alias("x"), F.col("up").alias("new_x")), "x", "left")
        new_x = F.coalesce("new_x", "x")
        live = checkpoint(named.select(F.least(new_x, "new_y").alias("x"), F.greatest(new_x, "new_y").alias("y")).filter("x < y").distinct())
    else:
        raise RuntimeError("components didn't settle")
    out = first.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node"))
    for hooks in steps:
        out = out.join(hooks.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return checkpoint(out)
