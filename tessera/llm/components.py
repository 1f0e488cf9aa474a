"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


#: A node with more than 1/HUBS of all links is a hub; there are at most twice HUBS of them.
HUBS = 10_000


def _with_least(sides: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """sides(a, b) with a's `low` from least(a, low, n). Hubs' rows meet a broadcast table where they are, the others' a
    shuffled one, so a hub's links stay spread over tasks."""
    hubs, others = least.where(F.col("n") * HUBS > links).drop("n"), least.where(F.col("n") * HUBS <= links).drop("n")
    return sides.join(F.broadcast(hubs), "a").union(sides.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(others, "a"))


def _star(links: DataFrame, both: bool, count: int) -> DataFrame:
    """Large star (both): each node hands its larger neighbours its least neighbour. Small star: each node hands itself
    and its smaller neighbours the least of them."""
    if both:
        sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
        out = _with_least(sides.where("b > a"), least, count).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        low = _with_least(links, least, count).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = low.union(least.select("a", F.col("low").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the least node reachable) for every node that a link names; links has integer columns a, b.

    Joins and partial aggregates only, and hubs are joined by broadcast, so no task takes all links of a hub. Each half
    round is written to the shared folder; the rounds end when the links stop changing, all then pointing at the least node.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    marks = F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    current, k = scratch.save(f"{name}-0", links), 0
    mark = tuple(current.agg(*marks).first())
    while True:
        k += 1
        half = scratch.save(f"{name}-{k}-large", _star(current, True, mark[0]))
        following = scratch.save(f"{name}-{k}", _star(half, False, mark[0]))
        found = tuple(following.agg(*marks).first())
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-{k}-large")
        current = following
        if found == mark:
            break
        mark = found
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
