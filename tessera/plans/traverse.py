"""Traversals as joins of frontiers with an edge table: one join a level for all sources together.

Edges are tables of `#from`, `#to`. A level's frontier and what has been seen are cut (written) so that plans stay short
and a lost executor costs no more than a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.checkpoint import cut

#: Up to so many levels are one plan; beyond, each level is cut and the end looked for.
INLINE_LEVELS = 2


def reach(edges: DataFrame, seeds: DataFrame, least: int, most: int | None) -> DataFrame:
    """`#seed`, `#node`: every node whose shortest distance from the seed is least to most hops, the seed itself left out.

    seeds has one column, `#seed`, without repeats.
    """
    steps = edges.where("`#from` <> `#to`").distinct()
    seen = seeds.select("#seed", F.col("#seed").alias("#node"), F.lit(0).alias("#depth"))
    if most is not None and most <= INLINE_LEVELS:
        frontier = seen
        for d in range(1, most + 1):
            found = frontier.join(steps, F.col("#node") == F.col("#from")).select("#seed", F.col("#to").alias("#node")).distinct()
            frontier = found.join(seen.select("#seed", "#node"), ["#seed", "#node"], "left_anti").withColumn("#depth", F.lit(d))
            seen = seen.unionByName(frontier)
    else:
        steps, seen = cut(steps), cut(seen)
        frontier, d = seen, 0
        while most is None or d < most:
            d += 1
            found = frontier.join(steps, F.col("#node") == F.col("#from")).select("#seed", F.col("#to").alias("#node")).distinct()
            frontier = cut(found.join(seen.select("#seed", "#node"), ["#seed", "#node"], "left_anti").withColumn("#depth", F.lit(d)))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
    return seen.where((F.col("#depth") >= max(1, least)) & (F.col("#node") != F.col("#seed"))).select("#seed", "#node")


def shortest(edges: DataFrame, pairs: DataFrame, most: int | None, every: bool) -> DataFrame:
    """`#a`, `#b`, `#path` (array of nodes) for the pairs that are connected within most hops.

    Of several shortest paths the least is given, or with `every` all of them, as often as parallel edges make them.
    From a node to itself leads the path of that node alone. Levels end when each pair is met or no node is new.
    """
    steps, pairs = cut(edges.where("`#from` <> `#to`")), cut(pairs.distinct())
    seeds = pairs.select(F.col("#a").alias("#seed")).distinct()
    frontier = cut(seeds.select("#seed", F.col("#seed").alias("#node"), F.array("#seed").alias("#path")))
    seen = frontier.select("#seed", "#node")
    met = pairs.where("`#a` = `#b`").select("#a", "#b", F.array("#a").alias("#path"))
    left = cut(pairs.where("`#a` <> `#b`"))
    d = 0
    while (most is None or d < most) and not left.isEmpty():
        d += 1
        found = frontier.join(steps, F.col("#node") == F.col("#from")).select("#seed", F.col("#to").alias("#node"), F.concat("#path", F.array("#to")).alias("#path"))
        found = found.join(seen, ["#seed", "#node"], "left_anti")
        if not every:
            found = found.groupBy("#seed", "#node").agg(F.min("#path").alias("#path"))
        frontier = cut(found)
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier.select("#seed", "#node").distinct()))
        arrived = frontier.withColumnsRenamed({"#seed": "#a", "#node": "#b"}).join(left, ["#a", "#b"], "left_semi")
        met = met.unionByName(arrived.select("#a", "#b", "#path"))
        left = cut(left.join(frontier.select(F.col("#seed").alias("#a"), F.col("#node").alias("#b")), ["#a", "#b"], "left_anti"))
        # a source all of whose targets are met needs no further levels
        frontier = frontier.join(left.select(F.col("#a").alias("#seed")).distinct(), "#seed", "left_semi")
    return met
