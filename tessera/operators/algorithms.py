"""Graph algorithms as table-valued procedures over one relationship table.

Every vertex of both endpoint tables takes part, isolated ones too. Where the endpoint tables differ, a vertex is told
apart by its table in the high bits; node_id is the offset again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import RelTable
from tessera.errors import BindError
from tessera.plans.checkpoint import cut

SHIFT = 44
DAMPING, RANK_ROUNDS, RANK_TOLERANCE = 0.85, 20, 1e-6
LABEL_ROUNDS = 100


class Graph:
    """vertices: v; edges: s, d; both in one id space."""

    def __init__(self, session, rel_name: str):
        if not isinstance(rel_name, str):
            raise BindError("a procedure takes a relationship table's name")
        catalog = session.catalog
        self.rel: RelTable = catalog.rel(rel_name)
        self.source, self.target = catalog.node(self.rel.source), catalog.node(self.rel.target)
        self.one = self.source.name == self.target.name
        ids = lambda t: t.rows.select(self.tag(F.col("_id"), t.id).alias("v"))
        self.vertices = ids(self.source) if self.one else ids(self.source).unionAll(ids(self.target))
        self.edges = self.rel.rows.select(self.tag(F.col("_src"), self.source.id).alias("s"), self.tag(F.col("_dst"), self.target.id).alias("d"))

    def tag(self, c, table: int):
        return c if self.one else c + F.lit(table << SHIFT)

    def offset(self, c):
        return c if self.one else c.bitwiseAND(F.lit((1 << SHIFT) - 1))

    def undirected(self) -> DataFrame:
        """Each pair of different neighbours once, as s < d."""
        return self.edges.where("s <> d").select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct()

    def both_ways(self) -> DataFrame:
        u = self.undirected()
        return u.unionAll(u.select(F.col("d").alias("s"), F.col("s").alias("d")))

    def keys(self) -> DataFrame:
        """v, key: primary keys, as text where the two tables' types differ."""
        tables = [self.source] if self.one else [self.source, self.target]
        kinds = {t.columns[t.key].simpleString() for t in tables}
        parts = [t.rows.select(self.tag(F.col("_id"), t.id).alias("v"), F.col(f"`{t.key}`").cast("string" if len(kinds) > 1 else next(iter(kinds))).alias("key")) for t in tables]
        return parts[0] if self.one else parts[0].unionAll(parts[1])


def degree_centrality(session, rel: str) -> DataFrame:
    """node_id, out_degree, in_degree; parallel edges count, a loop counts on both sides."""
    g = Graph(session, rel)
    out = g.edges.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("o"))
    into = g.edges.groupBy(F.col("d").alias("v")).agg(F.count("*").alias("i"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return g.vertices.join(out, "v", "left").join(into, "v", "left").select(g.offset(F.col("v")).alias("node_id"), zero("o").alias("out_degree"), zero("i").alias("in_degree"))


def least_reachable(links: DataFrame) -> DataFrame:
    """v, root for every vertex that has a link (s < d): alternating large and small stars until nothing changes."""
    current, mark = cut(links.select(F.col("d").alias("a"), F.col("s").alias("b"))), None
    while True:
        sides = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = sides.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
        current = cut(small.where("a > b").distinct())
        found = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        mark = found
    return current.select(F.col("a").alias("v"), F.col("b").alias("root")).union(current.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _components(g: Graph) -> DataFrame:
    return g.vertices.join(least_reachable(g.undirected()), "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def wcc(session, rel: str) -> DataFrame:
    """node_id, component_id: the least vertex of the weakly connected component."""
    g = Graph(session, rel)
    return _components(g).select(g.offset(F.col("v")).alias("node_id"), g.offset(F.col("root")).alias("component_id"))


def pagerank(session, rel: str) -> DataFrame:
    """node_id (primary key), score: damping 0.85, at most 20 rounds, an end once no score moves by 1e-6; parallel edges
    weigh by their number, vertices without a way out spread evenly."""
    g = Graph(session, rel)
    outs = g.edges.groupBy("s").agg(F.count("*").alias("n"))
    weights = cut(g.edges.groupBy("s", "d").agg(F.count("*").alias("k")).join(outs, "s").select("s", "d", (F.col("k") / F.col("n")).alias("w")))
    vertices = cut(g.vertices.join(outs.select(F.col("s").alias("v"), F.lit(True).alias("leads")), "v", "left").select("v", F.coalesce("leads", F.lit(False)).alias("leads")))
    n = vertices.count()
    if not n:
        return g.keys().select(F.col("key").alias("node_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    ranks = vertices.select("v", "leads", F.lit(1.0 / n).alias("r"))
    for k in range(RANK_ROUNDS):
        lost = ranks.agg(F.coalesce(F.sum(F.when(~F.col("leads"), F.col("r"))), F.lit(0.0))).first()[0]
        got = ranks.join(weights, F.col("v") == F.col("s")).groupBy(F.col("d").alias("v")).agg(F.sum(F.col("r") * F.col("w")).alias("in"))
        base = (1 - DAMPING) / n + DAMPING * lost / n
        moved = ranks.join(got, "v", "left").select("v", "leads", "r", (F.lit(base) + DAMPING * F.coalesce("in", F.lit(0.0))).alias("new"))
        moved = cut(moved)
        step = moved.agg(F.max(F.abs(F.col("new") - F.col("r")))).first()[0]
        ranks = moved.select("v", "leads", F.col("new").alias("r"))
        if step < RANK_TOLERANCE:
            break
    return ranks.join(g.keys(), "v").select(F.col("key").alias("node_id"), F.col("r").alias("score"))


def label_propagation(session, rel: str) -> DataFrame:
    """node_id, community: labels move one vertex after another in the order of ids, to the commonest label among its
    neighbours, the least of ties, until a round changes nothing (100 rounds at most). Components don't touch, so each is
    a task of its own; the order makes a component one task's work."""
    g = Graph(session, rel)
    loops = g.edges.where("s = d").distinct()
    near = g.both_ways().unionAll(loops).groupBy(F.col("s").alias("v")).agg(F.collect_set("d").alias("near"))
    rows = _components(g).join(near, "v", "left")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v")
        label = {v: v for v in part["v"]}
        near = {v: list(n) for v, n in zip(part["v"], part["near"]) if n is not None}
        for _ in range(LABEL_ROUNDS):
            changed = False
            for v in part["v"]:
                seen: dict[int, int] = {}
                for u in near.get(v, ()):
                    seen[label[u]] = seen.get(label[u], 0) + 1
                if seen:
                    best = min(seen, key=lambda x: (-seen[x], x))
                    changed |= best != label[v]
                    label[v] = best
            if not changed:
                break
        return pd.DataFrame({"v": list(label), "community": list(label.values())})

    found = rows.groupBy("root").applyInPandas(settle, "v long, community long")
    return found.select(g.offset(F.col("v")).alias("node_id"), g.offset(F.col("community")).alias("community"))


def triangle_count(session, rel: str) -> DataFrame:
    """node_id, triangles of the simple undirected graph. Edges point from the lesser to the greater degree, so that a
    hub opens few wedges."""
    g = Graph(session, rel)
    u = cut(g.undirected())
    degree = u.select(F.col("s").alias("v")).unionAll(u.select(F.col("d").alias("v"))).groupBy("v").agg(F.count("*").alias("k"))
    ranked = u.join(degree.select(F.col("v").alias("s"), F.struct("k", "v").alias("ks")), "s").join(degree.select(F.col("v").alias("d"), F.struct("k", "v").alias("kd")), "d")
    up = cut(ranked.select(F.least("ks", "kd")["v"].alias("a"), F.greatest("ks", "kd")["v"].alias("b")))
    wedges = up.join(up.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = wedges.join(u.select(F.col("s").alias("b"), F.col("d").alias("c")), ["b", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return g.vertices.join(corners, "v", "left").select(g.offset(F.col("v")).alias("node_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("triangles"))


def betweenness(session, rel: str) -> DataFrame:
    """node_id, score: shares of shortest paths through each vertex, undirected, not normalised. All sources advance
    together: forth by levels with path counts, back by levels with dependencies."""
    g = Graph(session, rel)
    steps = cut(g.both_ways())
    levels = [cut(g.vertices.select(F.col("v").alias("o"), "v", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("o", "v")
    while True:
        found = levels[-1].join(steps, F.col("v") == F.col("s")).groupBy("o", F.col("d").alias("v")).agg(F.sum("paths").alias("paths"))
        following = cut(found.join(seen, ["o", "v"], "left_anti"))
        if following.isEmpty():
            break
        levels.append(following)
        seen = cut(seen.unionAll(following.select("o", "v")))
    total, back = None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k]
        if back is not None:
            here = here.join(back, ["o", "v"], "left")
        here = here.select("o", "v", "paths", (F.coalesce("dep", F.lit(0.0)) if back is not None else F.lit(0.0)).alias("dep"))
        total = here.select("v", "dep") if total is None else total.unionAll(here.select("v", "dep"))
        parents = here.select("o", F.col("v").alias("w"), ((1 + F.col("dep")) / F.col("paths")).alias("share")).join(steps, F.col("w") == F.col("s"))
        parents = parents.select("o", F.col("d").alias("v"), "share").groupBy("o", "v").agg(F.sum("share").alias("share"))
        back = cut(levels[k - 1].join(parents, ["o", "v"]).select("o", "v", (F.col("paths") * F.col("share")).alias("dep")))
    sums = g.vertices.select("v", F.lit(0.0).alias("dep")) if total is None else g.vertices.select("v", F.lit(0.0).alias("dep")).unionAll(total)
    scores = sums.groupBy("v").agg((F.sum("dep") / 2).alias("score"))
    return scores.select(g.offset(F.col("v")).alias("node_id"), "score")


def dijkstra(session, source_key, target_key, rel: str, weight: str) -> DataFrame:
    """path (primary keys), cost of the cheapest directed way; no row without one. A missing weight is 1. Of equal costs
    the least path counts. Costs are relaxed level by level, and nothing dearer than the best way found goes on."""
    g = Graph(session, rel)
    keys = g.keys()
    kind = keys.schema["key"].dataType
    ends = []
    for key, table in ((source_key, g.source), (target_key, g.target)):
        hit = table.rows.where(F.col(f"`{table.key}`") == F.lit(key)).select(g.tag(F.col("_id"), table.id)).take(1)
        if not hit:
            raise BindError(f"no node with key {key!r} in '{table.name}'")
        ends.append(hit[0][0])
    start, end = ends
    schema = T.StructType([T.StructField("path", T.ArrayType(kind)), T.StructField("cost", T.DoubleType())])
    if start == end:
        return session.spark.createDataFrame([([source_key], 0.0)], schema)
    w = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0)) if weight in g.rel.columns else F.lit(1.0)
    edges = cut(g.rel.rows.select(g.tag(F.col("_src"), g.source.id).alias("s"), g.tag(F.col("_dst"), g.target.id).alias("d"), w.alias("w")).groupBy("s", "d").agg(F.min("w").alias("w")))
    best = cut(session.spark.createDataFrame([(start, 0.0, [start])], "v long, cost double, path array<long>"))
    frontier, bound = best, None
    while True:
        tried = frontier.join(edges, F.col("v") == F.col("s")).select(F.col("d").alias("v"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("d")).alias("path"))
        if bound is not None:
            tried = tried.where(F.col("cost") <= F.lit(bound))
        tried = tried.groupBy("v").agg(F.min(F.struct("cost", "path")).alias("t"))
        old = best.select("v", F.struct("cost", "path").alias("old"))
        frontier = cut(tried.join(old, "v", "left").where(F.col("old").isNull() | (F.col("t") < F.col("old"))).select("v", "t.cost", "t.path"))
        if frontier.isEmpty():
            break
        best = cut(best.unionByName(frontier).groupBy("v").agg(F.min(F.struct("cost", "path")).alias("t")).select("v", "t.cost", "t.path"))
        hit = best.where(F.col("v") == end).select("cost").take(1)
        bound = hit[0][0] if hit else None
    way = best.where(F.col("v") == end).select("cost", F.posexplode("path").alias("k", "v")).join(keys, "v")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("k", "key"))), lambda x: x["key"])
    return way.groupBy("cost").agg(ordered.alias("path")).select("path", "cost")


def tables(session) -> DataFrame:
    """name, type: node tables, then relationship tables, in the order of their creation."""
    rows = [(t.name, t.kind) for t in (*session.catalog.nodes(), *session.catalog.rels())]
    return session.spark.createDataFrame(rows, "name string, type string")


PROCEDURES: dict[str, Callable[..., DataFrame]] = {
    "degree_centrality": degree_centrality,
    "wcc": wcc,
    "dijkstra": dijkstra,
    "pagerank": pagerank,
    "label_propagation": label_propagation,
    "triangle_count": triangle_count,
    "betweenness": betweenness,
    "dbms.tables": tables,
}
