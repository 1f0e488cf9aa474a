"""Embedding near-duplicates by a robust-pruned flat graph.

Cluster shards overlap: each vector goes to its OVERLAP nearest centroids, and a cluster larger than SPLIT is clustered
again, until shards have a fixed size; only a cluster that is one dense group, many of whose pairs are links or which
doesn't fall apart, stays whole and is cut into blocks, a task taking two of them, for there every pair counts. In each shard every vector's nearest candidates
are robust-pruned to a short adjacency list; the lists of a vector from all its shards are united. Then each vector is a
query: a greedy beam search from the shard's medoid, then an expansion through every vector found in range. Pairs found
are verified in double precision. Queries, half of them with links, are compared with brute force over all vectors; the
overlap is widened where recall falls short, and all blocks are compared where that doesn't help.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_hot, small_side
from tessera.llm.components import components
from tessera.llm.ngram_join import Forest, each_group, in_blocks

THRESHOLD = 0.9
#: Centroids are fitted on at most SAMPLE vectors and SAMPLE_FLOATS numbers, those whose hashed vec_ids are smallest.
SAMPLE, SAMPLE_FLOATS, MOST_CLUSTERS, PER_CLUSTER, ROUNDS = 20_000, 4_000_000, 4096, 400, 8
OVERLAP, BLOCK = 3, 1024
#: A cluster of more than SPLIT members is clustered again into at most FAN parts, LEVELS times at most, on some SUBSAMPLE
#: of them. It stays whole, to be compared block by block, where more than DENSE of the sampled pairs are links, or where a
#: part would hold more than LARGEST of the sample. A member goes to its WIDE nearest parts.
SPLIT, FAN, LEVELS, SUBSAMPLE, DENSE, LARGEST, WIDE = 1024, 64, 4, 2000, 0.2, 0.5, 2
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 32
#: The overlap grows while recall is below RECALL and at most to WIDEST; below LEAST_RECALL all pairs are compared.
AUDIT, RECALL, WIDEST, LEAST_RECALL = 256, 0.97, 12, 0.9


def usable(column: str = "embedding"):
    """Not null, not empty, every component finite, not all zero."""
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    """Unit rows in double precision; first by the largest component, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty cluster keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        home = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(x: np.ndarray) -> np.ndarray:
    """Adjacency lists (padded with -1) of at most DEGREE: nearest candidates first, dropping those ALPHA times nearer to
    a kept neighbour than to the vector itself."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1)
    sims = (x.astype(np.float32) @ x.T.astype(np.float32)).clip(-1, 1)
    np.fill_diagonal(sims, -2)
    near = np.argpartition(-sims, k - 1, 1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), 1, kind="stable"), 1)
    away = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
    alive, kept, count = np.ones((n, k), bool), np.zeros((n, k), bool), np.zeros(n, int)
    for r in range(k):
        take = alive[:, r] & (count < DEGREE)
        kept[:, r] = take
        count += take
        rows = np.flatnonzero(take)
        if len(rows) and r + 1 < k:
            between = np.sqrt(np.maximum(0, 2 - 2 * sims[near[rows, r][:, None], near[rows, r + 1 :]]))
            alive[rows, r + 1 :] &= ALPHA * between > away[rows, r + 1 :]
    out = np.full((n, DEGREE), -1)
    out[np.repeat(np.arange(n), kept.sum(1)), (np.cumsum(kept, 1) - 1)[kept]] = near[kept]
    return out


def with_reverse(adjacency: list[np.ndarray], n: int) -> np.ndarray:
    """Edges in both directions, as padded lists."""
    a = np.repeat(np.arange(n), [len(x) for x in adjacency])
    b = np.concatenate(adjacency).astype(int) if len(a) else np.zeros(0, int)
    codes = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = codes // n, codes % n
    width = np.bincount(a, minlength=n)
    out = np.full((n, max(1, width.max(initial=1))), -1)
    out[a, np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)] = b
    return out


def range_search(x: np.ndarray, adjacency: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs found at or above the threshold, every row being a query."""
    n = len(x)
    seen, every = np.zeros((n, n), bool), np.arange(n)
    medoid = int((x @ x.mean(0)).argmax())
    seen[every, medoid] = True
    seen[every, every] = True
    pool = np.stack([np.full(n, medoid), every], 1)
    score = np.stack([x @ x[medoid], np.ones(n)], 1)
    score[medoid, 0] = -2
    done = np.zeros_like(pool, bool)
    hits = [(every, every)]
    while True:
        open_ = np.where(done | (score <= -2), -3, score)
        best = open_.argmax(1)
        rows = np.flatnonzero(open_[every, best] > -2)
        if not len(rows):
            break
        done[rows, best[rows]] = True
        near = adjacency[pool[rows, best[rows]]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        q, v = rows[r], near[r, c]
        s = np.einsum("ij,ij->i", x[q], x[v])
        seen[q, v] = True
        hits.append((q[s >= threshold], v[s >= threshold]))
        wide = np.full((n, adjacency.shape[1]), -3.0)
        ids = np.zeros((n, adjacency.shape[1]), int)
        wide[q, c], ids[q, c] = s, v
        pool, score, done = np.hstack([pool, ids]), np.hstack([score, wide]), np.hstack([done, np.zeros_like(ids, bool)])
        top = np.argpartition(-score, min(BEAM, score.shape[1]) - 1, 1)[:, :BEAM]
        pool, score, done = (np.take_along_axis(m, top, 1) for m in (pool, score, done))
    q, v = (np.concatenate(m) for m in zip(*hits))
    found = [(q, v)]
    while len(q):  # through what is in range, to all that is in range
        following = []
        for part in np.array_split(np.arange(len(q)), max(1, len(q) * adjacency.shape[1] // 2_000_000)):
            near = adjacency[v[part]]
            a, b = np.repeat(q[part], near.shape[1]), near.ravel()
            ok = b >= 0
            code = np.unique(a[ok] * n + b[ok])
            a, b = code // n, code % n
            ok = ~seen[a, b]
            a, b = a[ok], b[ok]
            seen[a, b] = True
            s = np.einsum("ij,ij->i", x[a], x[b])
            following.append((a[s >= threshold], b[s >= threshold]))
        q, v = (np.concatenate(m) for m in zip(*following))
        found.append((q, v))
    return tuple(np.concatenate(m) for m in zip(*found))


def _vectors(b: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(b["vector"]), float).reshape(len(b), -1)


def _same_width(b: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from zip(starts, np.append(starts[1:], len(b)))


def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shard rows -> rep, near: the vector's adjacency list in this task, by rep."""
    for b, starts in each_group(batches, ["cluster", "i", "j"]):
        rep, near = b["rep"].to_numpy(), [None] * len(b)
        for s, e in _same_width(b, starts):
            lists = robust_prune(_vectors(b.iloc[s:e]))
            for k, row in enumerate(lists):
                near[s + k] = rep[s + row[row >= 0]]
        yield pd.DataFrame({"rep": rep, "near": near})


def search(threshold: float):
    """Shard rows with united lists -> rep, links, root; a pair counts in the least cluster that both its vectors are in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts in each_group(batches, ["cluster", "i", "j"]):
            rep, own, copies, cluster, i, j = (b[c].to_numpy() for c in ("rep", "own", "copies", "cluster", "i", "j"))
            links, roots = np.zeros(len(b), np.int64), rep.copy()
            homes, near = b["homes"].tolist(), b["near"].tolist()
            for s, e in _same_width(b, starts):
                x, n = _vectors(b.iloc[s:e]), e - s
                order = np.argsort(rep[s:e])
                ranked = rep[s:e][order]
                lists = []
                for k in range(s, e):
                    at = np.minimum(np.searchsorted(ranked, near[k]), n - 1)
                    lists.append(order[at[ranked[at] == near[k]]])
                q, v = range_search(x, with_reverse(lists, n), threshold)
                q, v = np.minimum(q, v), np.maximum(q, v)
                code = np.unique((q * n + v)[q < v])
                q, v = code // n, code % n
                if i[s] != j[s]:
                    across = own[s + q] != own[s + v]
                    q, v = q[across], v[across]
                ours = np.array([min(set(homes[s + a]) & set(homes[s + c])) == cluster[s] for a, c in zip(q, v)], bool)
                qo, vo = q[ours], v[ours]
                np.add.at(links, s + qo, copies[s + vo])
                np.add.at(links, s + vo, copies[s + qo])
                forest, place = Forest(n), np.argsort(order)
                for a, c in zip(q, v):
                    forest.join(int(place[a]), int(place[c]))
                roots[s:e] = [ranked[forest.find(int(p))] for p in place]
            yield pd.DataFrame({"rep": rep, "links": links, "root": roots})

    return run


def split_large(placed: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """placed(rep, copies, vector, cluster) with large clusters clustered again; a vector then is in more of them."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(rows)
        linked = (x @ x.T >= threshold).sum() - len(x)
        centroids = None
        if linked <= DENSE * len(x) * (len(x) - 1):
            found = fit_centroids(x, max(2, min(FAN, len(x), math.ceil(rows["members"].iloc[0] / PER_CLUSTER))))
            if np.bincount((x @ found.T).argmax(1)).max() <= LARGEST * len(x):
                centroids = found.tobytes()
        return pd.DataFrame({"cluster": rows["cluster"][:1], "members": rows["members"][:1], "centroids": [centroids]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cluster, part in b.groupby("cluster"):
                x = _vectors(part)
                c = np.frombuffer(part["centroids"].iloc[0], float).reshape(-1, x.shape[1])
                k = min(WIDE, len(c))
                near = np.argpartition(-(x @ c.T), k - 1, 1)[:, :k]
                own = np.array([xxhash.xxh3_64_intdigest(f"{cluster}/{j}") >> 1 for j in range(len(c))], np.int64)
                rows = np.repeat(np.arange(len(x)), k)
                yield part.iloc[rows][["rep", "copies", "vector"]].assign(cluster=own[near.ravel()])

    done = None
    for level in range(LEVELS):
        held = scratch.save(f"{name}-sizes-{level}", placed.groupBy("cluster").agg(F.count("*").alias("members")))
        large = held.where(F.col("members") > SPLIT)
        if large.isEmpty():
            break
        sizes = join_hot(placed, held, "cluster", "members")
        drawn = F.pmod(F.xxhash64("rep", "cluster"), F.lit(1 << 30)) < F.lit(float(SUBSAMPLE << 30)) / F.col("members")
        fitted = sizes.where((F.col("members") > SPLIT) & drawn).groupBy("cluster").applyInPandas(fit, "cluster long, members long, centroids binary")
        fitted = scratch.save(f"{name}-fitted-{level}", fitted)
        known = join_hot(placed, fitted, "cluster", "members", 1000)
        known = scratch.save(f"{name}-known-{level}", known)
        whole = known.where("centroids is null").select("rep", "copies", "vector", "cluster")
        done = whole if done is None else done.unionByName(whole)
        again = known.where("centroids is not null").select("rep", "copies", "vector", "cluster", "centroids")
        placed = scratch.save(f"{name}-{level}", again.mapInPandas(deal, "rep long, copies long, vector binary, cluster long").distinct())
    return placed if done is None else done.unionByName(placed)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall: a row for each row of embeddings(vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept; so do rows
    without a vec_id. Vectors of different lengths don't link. Equal vectors are one vector for the search, and count
    as often as they occur, repeated rows included. Of a vec_id with several vectors the least takes part; rows with another one link with
    nothing. Other columns, labels included, are ignored. audit_recall is the mean share of links found over the audited
    vectors that have any, null where none has. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "graph")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(), F.col("embedding").cast("array<double>")).alias("embedding"))
    rows = rows.withColumn("embedding", F.when(F.col("vec_id").isNotNull(), F.col("embedding")))
    several = scratch.save("several", rows.where("embedding is not null").groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if not several.isEmpty():
        some = small_side(several)
        least = rows.join(some, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("one"))
        other = rows.join(some, "vec_id", "left_semi").join(least, "vec_id").withColumn("embedding", F.when(F.col("embedding") == F.col("one"), F.col("embedding"))).drop("one")
        rows = rows.join(some, "vec_id", "left_anti").unionByName(other)
    rows = scratch.save("rows", rows)
    classes = scratch.save("classes", rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    lengths = {r.d: r.n for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    centroids, first = {}, 0
    for d, n in sorted(lengths.items()):
        of = classes.where(F.size("embedding") == d).select("rep", "embedding")
        picked = of.select("rep").orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(SAMPLE, SAMPLE_FLOATS // d)))
        x = unit([r.embedding for r in of.join(F.broadcast(picked), "rep").orderBy("rep").collect()])
        centroids[d] = first, fit_centroids(x, max(1, min(MOST_CLUSTERS, math.ceil(n / PER_CLUSTER), len(x))))
        first += len(centroids[d][1])

    def deal(overlap: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for d, part in b.groupby(b["embedding"].map(len)):
                    x = unit(part["embedding"])
                    base, c = centroids.get(d, (-d, np.zeros((1, d))))  # a length too rare to be listed is a cluster of its own
                    if overlap is None:
                        base, c = -d, np.zeros((1, d))
                    k = min(overlap or 1, len(c))
                    homes = base + np.argpartition(-(x @ c.T), k - 1, 1)[:, :k]
                    rows = np.repeat(np.arange(len(x)), k)
                    vectors = np.array([v.tobytes() for v in x], object)
                    yield pd.DataFrame({"rep": part["rep"].to_numpy()[rows], "copies": part["copies"].to_numpy()[rows], "vector": vectors[rows], "cluster": homes.ravel()})

        return run

    def link(overlap: int | None) -> DataFrame:
        """Links found with so many clusters a vector; None: with all vectors of a length in one cluster, block by block."""
        placed = scratch.save(f"dealt-{overlap}", classes.select("rep", "copies", "embedding").mapInPandas(deal(overlap), "rep long, copies long, vector binary, cluster long"))
        if overlap is not None:
            placed = scratch.save(f"placed-{overlap}", split_large(placed, threshold, scratch, f"split-{overlap}"))
        held = scratch.save(f"held-{overlap}", placed.groupBy("cluster").agg(F.count("*").alias("members")))
        grouped = lambda df: df.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
        lists = grouped(in_blocks(placed.drop("copies"), "cluster", "rep", held, BLOCK)).mapInPandas(build, "rep long, near array<long>")
        united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        homes = placed.groupBy("rep").agg(F.collect_set("cluster").alias("homes"))
        tasks = grouped(in_blocks(placed.join(united.join(homes, "rep"), "rep"), "cluster", "rep", held, BLOCK))
        return scratch.save(f"found-{overlap}", tasks.mapInPandas(search(threshold), "rep long, links long, root long"))

    def true_links(sample: pd.DataFrame):
        by_length = {d: (p["rep"].to_numpy(), unit(p["embedding"])) for d, p in sample.groupby(sample["embedding"].map(len))}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for d, part in b.groupby(b["embedding"].map(len)):
                    if d in by_length:
                        rep, y = by_length[d]
                        hit = (unit(part["embedding"]) @ y.T >= threshold) & (part["rep"].to_numpy()[:, None] != rep[None, :])
                        yield pd.DataFrame({"rep": rep, "links": part["copies"].to_numpy() @ hit})

        return run

    def audit(counts: DataFrame) -> float | None:
        """Half of the queries are any vectors, half some that were found to have links: each one's share of its links."""
        order = F.xxhash64("rep", F.lit(1)), "rep"
        any_ = classes.select("rep").orderBy(*order).limit(AUDIT // 2)
        linked = counts.where("links > 0").select("rep").orderBy(*order).limit(AUDIT // 2)
        chosen = classes.select("rep", "embedding").join(F.broadcast(any_.union(linked).distinct()), "rep").toPandas()
        if not len(chosen):
            return None
        truth = classes.mapInPandas(true_links(chosen), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("truth")).where("truth > 0")
        share = F.least(F.coalesce("links", F.lit(0)), "truth") / F.col("truth")
        return truth.join(counts, "rep", "left").agg(F.avg(share)).first()[0]

    overlap: int | None = OVERLAP
    while True:
        found = link(overlap)
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = audit(counts)
        if recall is None or recall >= RECALL or overlap is None or (overlap >= WIDEST and recall >= LEAST_RECALL):
            break
        overlap = 2 * overlap if overlap < WIDEST else None
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "links")
    result = (
        classes.join(counts, "rep", "left")
        .join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("embedding", "copies", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return join_hot(rows, scratch.save("result", result), "embedding", "copies").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
    )
