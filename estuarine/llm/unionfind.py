"""Connected components as joins: smallest labels around every node, then shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.session import materialize


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for `nodes` (id): the smallest id reachable over `links` (a, b).

    Links are contracted until none is left: every node with links hooks to its smallest
    neighbour if that is smaller, parents jump to their own parents until they are roots, and links
    between roots go on. At least every second node with links is hooked in two rounds. Each round is
    written to the shared folder, so a lost executor costs a round at most.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    parents: DataFrame | None = None
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        hook = materialize(hook)
        while True:  # trees flatten: parents of parents
            over = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = materialize(hook.join(over, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            hook = jumped.select("id", "up")
            if jumped.filter("moved").isEmpty():
                break
        to = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
        if parents is None:
            parents = hook
        else:
            parents = materialize(parents.join(to, "up", "left").select("id", F.coalesce("top", "up").alias("up")).union(hook))
        a = hook.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        b = hook.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct())
    if parents is None:
        return nodes.select("id", F.col("id").alias("component"))
    return materialize(nodes.select("id").join(parents, "id", "left").select("id", F.coalesce("up", "id").alias("component")))
