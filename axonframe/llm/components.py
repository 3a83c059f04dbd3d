"""Connected components of a link table, as DataFrame rounds.

Every round hooks each vertex to its smallest neighbour, shortens the pointers by
doubling, and contracts the links to those between different roots. A vertex that is no
local minimum disappears from the next round, so the links shrink geometrically and a
star, however many leaves it has, ends after one round. Nothing is collected: the driver
sees the number of remaining links only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _doubled(pointer: DataFrame) -> DataFrame:
    """Pointers (v, p) followed to their ends. Hooking is strictly downwards, so there
    are no cycles, and each pass halves the depth."""
    while True:
        up = pointer.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = cut(
            pointer.join(up.hint("merge"), "p", "left").select("v", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
        )
        pointer = step.select("v", "p")
        if step.filter("moved").isEmpty():
            return pointer


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root): each linked node with the smallest node
    reachable from it. Self links, repeats and either direction are accepted; nodes
    without a link to another node are absent. An empty table gives an empty table."""
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        # b > a: the smallest neighbour below b is a hook for b; the rest stay their own roots.
        hooks = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        roots = edges.select(F.col("a").alias("v")).distinct().join(hooks.hint("merge"), "v", "left_anti").select("v", F.col("v").alias("p"))
        pointer = _doubled(cut(hooks.unionByName(roots)))
        to = lambda c: pointer.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")).hint("merge")
        labels = (
            pointer
            if labels is None
            else cut(
                labels.join(pointer.select(F.col("v").alias("p"), F.col("p").alias("pp")).hint("merge"), "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
            )
        )
        edges = cut(
            edges.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .filter("a < b")
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.select(F.col("v").alias("node"), F.col("p").alias("root"))
