"""Connected components of a table of links, by alternating stars.

Every round maps each link to links with the smallest neighbour, first upwards (large star), then
downwards (small star); after a few rounds each node is linked to the smallest of its component
only. Nothing but links moves, hot nodes are joined with skew handling, and only the number of
links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import compact, materialised, parts


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the smallest node reachable.

    The number of links sets the number of tasks of a round: a round is a few joins of short rows,
    and small tables would otherwise become many tiny files.
    """
    now = compact(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _stars(now):
            break
        few = parts(now.count())
        upper = materialised(_large_star(now).coalesce(few))
        now = materialised(_small_star(upper).coalesce(few).distinct().coalesce(few))
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return compact(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component")))


def _stars(links: DataFrame) -> bool:
    """Whether each larger end has one link only and no smaller end is the larger one of another link."""
    twice = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.take(1):
        return False
    return not links.select("b").distinct().join(links.select(F.col("a").alias("b")), "b", "left_semi").take(1)


def extend_components(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: only components that these links join are worked on again."""
    if classes is None:
        return connected_components(links)
    at = classes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    to = classes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(at, "a", "left").join(to, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(between)
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = classes.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return compact(old.union(joined.join(classes, "node", "left_anti").select("node", "component")))
