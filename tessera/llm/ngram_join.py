"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops those unlikely to reach the threshold, and the
rest are compared exactly.

Texts with equal shingle sets form a class, which its least doc_id represents. Representatives that share a band meet in
its bucket. There their MinHash values are compared a few at a time, and a pair is dropped as soon as the posterior
probability (uniform prior) of a similarity at or above the threshold falls below the tolerance. The connected components
of what is left say which texts must come to one place; there the values decide again, pair by pair, which shingle sets
are compared exactly, and pruned pairs are not. Large buckets and groups are cut into blocks, and a task takes two blocks,
so a task holds at most two blocks of rows, and no step emits more than a row for each member of a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, WordIds, join_hot, lean, mix, shingles, small_side, word_hashes
from tessera.llm.components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-6
BUCKET_BLOCK, GROUP_BLOCK = 512, 256
CHUNK_SHINGLES = 100_000
COLUMNS = 4096

_RNG = np.random.default_rng(90210)
_XOR = _RNG.integers(0, 1 << 63, HASHES, np.uint64)
_MUL = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, ids: WordIds) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text. A text of fewer than five words is one shingle, one without words
    but not empty is one shingle of its characters; null and empty texts (white space alone too) have none."""
    words = word_hashes(text, ids)
    if len(words):
        return shingles(words, WIDTH)
    stripped = text.strip() if text else ""
    return np.array([xxhash.xxh3_64_intdigest(stripped, 1)] if stripped else [], np.uint64)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values for each non-empty set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x, out = np.concatenate(sets), np.empty((len(sets), HASHES), np.uint64)
    y = np.empty_like(x)
    for k in range(HASHES):
        np.bitwise_xor(x, _XOR[k], out=y)
        np.multiply(y, _MUL[k], out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    h = np.zeros((len(values), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    by_band = values.reshape(len(values), BANDS, ROWS)
    for r in range(ROWS):
        h = mix(h * np.uint64(31) + by_band[:, :, r])
    return h.view(np.int64)


SKETCH = "doc_id long, set_key binary, n_shingles int, values binary, bands array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """Identity, size, MinHash values (16 bits each) and band keys of each document's shingle set."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for b in batches:
            sets, rows, n = [], [], 0

            def settle() -> None:
                full = [s for s in sets if len(s)]
                values = minhashes(full) if full else np.zeros((0, HASHES), np.uint64)
                short, bands = (values & np.uint64(0xFFFF)).astype("<u2"), band_keys(values)
                k = 0
                for s in sets:
                    if len(s):
                        rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), short[k].tobytes(), bands[k]))
                        k += 1
                    else:
                        rows.append((None, 0, None, None))
                sets.clear()

            for text in b["text"]:
                sets.append(shingle_set(text, ids))
                n += len(sets[-1])
                if n >= CHUNK_SHINGLES:
                    settle()
                    n = 0
            settle()
            frame = pd.DataFrame(rows, columns=["set_key", "n_shingles", "values", "bands"])
            frame.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield frame

    return docs.select("doc_id", "text").mapInPandas(lean(make), SKETCH)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 0 to HASHES values compared: the least number of matches with which a pair stays. With a uniform prior,
    P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(HASHES + 1):
        below, m = 0.0, -1
        while True:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance or m >= n:
                break
        out.append(m if n else 0)
    return out


LEAST = least_matches()


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which row pairs are still likely after comparing their values STEP by STEP."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), int)
    for n in range(STEP, HASHES + 1, STEP):
        matches = matches + (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(1)
        stay = matches >= LEAST[n]
        alive, matches = alive[stay], matches[stay]
    return alive


class Forest:
    """Union-find over rows; the root is the least row."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def in_blocks(members: DataFrame, key: str, row: str, held: DataFrame, block: int) -> DataFrame:
    """members with columns i, j, side: a copy for each task (key, i <= j) that needs the row. held: key and its number
    of members; others are left out. Rows are dealt to blocks by hash, so no task sorts or counts a whole key."""
    n = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64(row), F.col("n")).cast("int")
    return (
        join_hot(members, held, key, "members")
        .where("members is not null")
        .withColumn("n", n)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("n", "other", "members")
    )


def each_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut at group ends (rows come sorted by keys), each with the groups' starts. What a batch's last group has
    is kept for the next batch; a group is two blocks at most."""
    rest: pd.DataFrame | None = None

    def starts(b: pd.DataFrame) -> np.ndarray:
        k = b[keys].to_numpy()
        return np.concatenate([[0], 1 + np.flatnonzero((k[1:] != k[:-1]).any(1))]) if len(b) else np.zeros(0, int)

    for b in batches:
        b = pd.concat([rest, b], ignore_index=True) if rest is not None and len(rest) else b
        s = starts(b)
        if len(s) < 2:
            rest = b
            continue
        rest = b.iloc[s[-1] :].reset_index(drop=True)
        yield b.iloc[: s[-1]], s[:-1]
    if rest is not None and len(rest):
        yield rest, np.array([0])


def group_pairs(own: np.ndarray, i: int, j: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The row pairs that the task (i, j) owns: those within the block, or across its two blocks."""
    if i == j:
        a, b = np.triu_indices(len(own), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(own == i), np.flatnonzero(own == j), indexing="ij"))
    return a + at, b + at


def likely_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket rows (rep, values, own, i, j) -> links a, b that span what pruning leaves, once a batch."""
    for b, starts in each_group(batches, ["band", "i", "j"]):
        values = np.frombuffer(b"".join(b["values"]), "<u2").reshape(len(b), HASHES)
        rep, own, i, j = (b[c].to_numpy() for c in ("rep", "own", "i", "j"))
        sizes = np.diff(np.append(starts, len(b)))
        found, seen = Forest(len(b)), {}
        lefts, rights, waiting = [], [], 0

        def settle() -> None:
            if lefts:
                a, c = np.concatenate(lefts), np.concatenate(rights)
                for k in survivors(values[a], values[c]):
                    found.join(int(a[k]), int(c[k]))
            lefts.clear()
            rights.clear()

        two = starts[(sizes == 2) & (i[starts] == j[starts])]
        lefts.append(two)
        rights.append(two + 1)
        for s, n in zip(starts, sizes):
            if n > 2 or (n == 2 and i[s] != j[s]):
                a, c = group_pairs(own[s : s + n], i[s], j[s], s)
                lefts.append(a)
                rights.append(c)
                waiting += len(a)
                if waiting > 100_000:
                    settle()
                    waiting = 0
        settle()
        for k in range(len(b)):
            r = found.find(k)
            if r != k:
                seen[(int(rep[r]), int(rep[k]))] = None
        yield pd.DataFrame(list(seen), columns=["a", "b"], dtype="int64")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared shingles of every two sets, by products of their 0/1 rows over the shared columns."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1
    doc, column = doc[many], column[many]
    out = np.zeros((len(sets), len(sets)), np.int64)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        a, z = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[doc[a:z], column[a:z] - low] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def exact_links(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Group rows (rep, copies, values, text, own, i, j) -> rep, links, root: how many documents outside its class it
    links to in this task, and the least representative it reaches there. Only pairs that outlast the pruning are
    compared, and only texts of such pairs are cut into shingles."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for b, starts in each_group(batches, ["component", "i", "j"]):
            rep, own, i, j, copies = (b[c].to_numpy() for c in ("rep", "own", "i", "j", "copies"))
            texts, links, roots = b["text"].tolist(), np.zeros(len(b), np.int64), rep.copy()
            values = np.frombuffer(b"".join(b["values"]), "<u2").reshape(len(b), HASHES)
            for s, e in zip(starts, np.append(starts[1:], len(b))):
                left, right = group_pairs(own[s:e], i[s], j[s], s)
                likely = survivors(values[left], values[right])
                left, right = left[likely], right[likely]
                rows = np.unique(np.concatenate([left, right]))
                if not len(rows):
                    continue
                sets = [shingle_set(texts[k], ids) for k in rows]
                size = np.array([len(x) for x in sets])
                a, c = np.searchsorted(rows, left), np.searchsorted(rows, right)
                shared = overlaps(sets)[a, c]
                linked = (shared >= threshold * (size[a] + size[c] - shared) - 1e-9) & (size[a] > 0) & (size[c] > 0)
                left, right = left[linked], right[linked]
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                order = np.argsort(rep[s:e], kind="stable")  # so that the least row is the least representative
                forest = Forest(e - s)
                place = np.argsort(order)
                for a, c in zip(place[left - s].tolist(), place[right - s].tolist()):
                    forest.join(a, c)
                roots[s:e] = [rep[s + order[forest.find(int(p))]] for p in place]
            yield pd.DataFrame({"rep": rep, "links": links, "root": roots})

    return compare


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, set_rep: a row for each row of docs.

    n_links counts the other rows whose sets of five-word shingles (lower-cased \\w+ words of whole texts) have a Jaccard
    similarity of at least the threshold; class_id is the least doc_id reachable by such links, the document's own where
    there are none; set_rep is the least doc_id with an equal set. Null and empty texts link with nothing. Repeated rows
    count as copies; a doc_id with several texts is compared by the least of them. Of
    pairs that share a band, one at 0.8 is pruned with a probability of some 1e-6. A null doc_id links with nothing and keeps a null class_id. Other columns are ignored. An empty
    table gives an empty result. The threshold must be 0.8 or more: bands miss a pair at 0.8 with probability 3e-6.
    """
    if threshold < THRESHOLD:
        raise ValueError("the bands are laid out for thresholds of 0.8 and above")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save("sketch", sketch(docs))
    full = rows.where("set_key is not null and doc_id is not null")
    classes = scratch.save(
        "classes",
        full.groupBy("set_key").agg(F.min(F.struct("doc_id", "values", "bands")).alias("first"), F.count("*").alias("copies")).select(
            "set_key", F.col("first.doc_id").alias("rep"), F.col("first.values").alias("values"), F.col("first.bands").alias("bands"), "copies"
        ),
    )
    placed = classes.select("rep", F.explode("bands").alias("band"))
    held = scratch.save("held", placed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"))
    dealt = in_blocks(placed, "band", "rep", held, BUCKET_BLOCK).join(classes.select("rep", "values").hint("merge"), "rep")
    likely = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep").mapInPandas(lean(likely_links), "a long, b long")
    groups = scratch.save("groups", components(likely, scratch, "likely"))
    sizes = scratch.save("sizes", groups.groupBy("component").agg(F.count("*").alias("members")))
    members = in_blocks(groups.withColumnRenamed("node", "rep"), "component", "rep", sizes, GROUP_BLOCK)
    with_text = (
        docs.join(small_side(groups.select(F.col("node").alias("doc_id"))), "doc_id")
        .select(F.col("doc_id").alias("rep"), "text")
        .join(classes.select("rep", "copies", "values"), "rep")
    )
    # one row a representative: repeated rows, and the least text where a doc_id has several
    with_text = with_text.groupBy("rep").agg(F.min("text").alias("text"), F.first("copies").alias("copies"), F.first("values").alias("values"))
    tasks = members.join(with_text, "rep").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    found = scratch.save("found", tasks.mapInPandas(lean(exact_links(threshold)), "rep long, links long, root long"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "linked")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = (
        classes.select("set_key", "rep", "copies")
        .join(counts, "rep", "left")
        .join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("set_key", "rep", "copies", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    classed = scratch.save("classed", classed)
    keyed = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return join_hot(keyed, classed, "set_key", "copies").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "doc_id").alias("set_rep")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one document of each class: the one with the class's id. Rows without a doc_id stay; of
    rows with the kept doc_id one of each text stays. Texts are moved only where a doc_id repeats or too many go."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.save("found", ngram_join(docs, threshold).select("doc_id", "class_id").where("doc_id is not null"))
    gone = found.where("doc_id <> class_id").select("doc_id").distinct()
    stay = docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = scratch.save("repeated", found.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return stay
    some = small_side(repeated)
    once = stay.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return stay.join(some, "doc_id", "left_anti").select(docs.columns).unionByName(once)
