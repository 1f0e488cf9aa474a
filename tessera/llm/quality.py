"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, and a temperature
that calibrates its probabilities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small_batches
from tessera.llm.language_mixture import fold

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Words are hashed to WORDS rows of DIMS sums, so the table has a fixed size whatever the vocabulary.
WORDS, DIMS, WINDOW, NONZERO = 1 << 14, 64, 2, 2
SLICES = 32
FAN_IN = 64
#: The network is fitted on at most this many labelled documents, those whose hashed doc_ids are smallest.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 3e-3, 1e-4
CHUNK_TOKENS = 100_000
SCALARS = 5
FEATURES = DIMS + SCALARS


class Slots(dict):
    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        k = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return k


def slots_of(text: str | None, slots: Slots) -> np.ndarray:
    tokens = TOKEN.findall(text.lower()) if text else []
    return np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each row's sparse ternary index vector: NONZERO places and signs, from a fixed seed."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIMS, (NONZERO, WORDS)), rng.integers(0, 2, (NONZERO, WORDS)) * 2.0 - 1


def add_contexts(table: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours within WINDOW in the same document."""
    places, signs = index_vectors.cached
    for o in range(1, WINDOW + 1):
        same = doc[:-o] == doc[o:]
        left, right = ids[:-o][same], ids[o:][same]
        for here, there in ((left, right), (right, left)):
            for k in range(NONZERO):
                table += np.bincount(here * DIMS + places[k][there], signs[k][there], WORDS * DIMS)


index_vectors.cached = index_vectors()


def word_table(docs: DataFrame) -> np.ndarray:
    """Context sums over all whole texts. Tasks send the rows they touched, compressed, in SLICES; a tree of merges with
    FAN_IN inputs each adds them, so no merge holds more than FAN_IN tables of one slice."""
    slices = WORDS // SLICES

    def pack(table: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(table.astype(np.int64).tobytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slots, table = Slots(), np.zeros(WORDS * DIMS)
        held, n = [], 0

        def settle() -> None:
            if held:
                add_contexts(table, np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]))
                held.clear()

        for b in batches:
            for text in b["text"]:
                held.append(slots_of(text, slots))
                n += len(held[-1])
                if n > 10 * CHUNK_TOKENS:
                    settle()
                    n = 0
        settle()
        parts = np.rint(table).reshape(SLICES, slices * DIMS)
        yield pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "part": TaskContext.get().partitionId(), "sums": [pack(p) for p in parts]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in rows["sums"])
        return pd.DataFrame({"slice": rows["slice"][:1], "part": rows["part"][:1] // FAN_IN, "sums": [pack(total)]})

    schema = "slice int, part long, sums binary"
    texts = docs.select("text")
    left = texts.rdd.getNumPartitions()
    sums = texts.mapInPandas(count, schema)
    while True:
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("to")).applyInPandas(merge, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    table = np.zeros((SLICES, slices * DIMS))
    with small_batches(docs.sparkSession):
        merged = sums.collect()  # SLICES rows of fixed size
    for r in merged:
        table[r.slice] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.sums)), np.int64)
    return table.reshape(WORDS, DIMS)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit rows, less what all words share."""
    rows = table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))
    used = np.abs(table).sum(1) > 0
    if used.any():
        rows[used] -= rows[used].mean(0)
    return (rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))).astype(np.float32)


def pool(vectors: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """A row a document: the mean of its word vectors, then log length, distinct share, share of tokens equal to
    their predecessor, share of the commonest token and the mean vector's length. A document without tokens has zeros."""
    out = np.zeros((len(docs), FEATURES), np.float32)
    sizes = np.array([len(d) for d in docs])
    (full,) = sizes.nonzero()
    if not len(full):
        return out
    ids, n = np.concatenate([docs[k] for k in full]), sizes[full]
    starts = np.cumsum(n) - n
    mean = np.add.reduceat(vectors[ids], starts, 0) / n[:, None]
    out[full, :DIMS] = mean
    for k, c in zip(full, n):
        d = docs[k]
        counts = np.bincount(d)
        counts = counts[counts > 0]
        out[k, DIMS:] = np.log1p(c), len(counts) / c, (d[1:] == d[:-1]).mean() if c > 1 else 0, counts.max() / c, 0
    out[full, -1] = np.linalg.norm(mean, axis=1)
    return out


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, features of every whole text; null and empty texts have zeros."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots()
        for b in batches:
            rows, held, n = [], [], 0
            for text in b["text"]:
                held.append(slots_of(text, slots))
                n += len(held[-1])
                if n > CHUNK_TOKENS:
                    rows.append(pool(vectors, held))
                    held, n = [], 0
            rows.append(pool(vectors, held))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "features": list(np.concatenate(rows))})

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, features array<float>")


class Network:
    """Two layers, standardised inputs, Adam; fit() keeps a fifth of the rows for the temperature."""

    def __init__(self, n_in: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / n_in), (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        self.mean, self.scale, self.temperature, self.constant = np.zeros(n_in), np.ones(n_in), 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return (h @ self.w[2] + self.w[3])[:, 0]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        if len(y) < 10 or len(np.unique(y)) < 2:  # nothing to separate: the share of label 1, or even odds
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, kept = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[kept].mean(0), x[kept].std(0) + 1e-6
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(kept), max(1, len(kept) // 128)):
                z = (x[at] - self.mean) / self.scale
                a = z @ self.w[0] + self.w[1]
                h = np.maximum(0, a)
                p = 1 / (1 + np.exp(-np.clip((h @ self.w[2] + self.w[3])[:, 0], -30, 30)))
                d = ((p - y[at]) / len(at))[:, None]
                back = (d @ self.w[2].T) * (a > 0)
                grads = [z.T @ back + DECAY * self.w[0], back.sum(0), h.T @ d + DECAY * self.w[2], d.sum(0)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        z, t = self.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(feats: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """Learn from labelled rows whose fold by 3 is not 1; a document with several labels counts by their mean, one with
    several texts by the least of their features."""
    known = labels.where(F.col(label).isNotNull() & (fold(3) != 1)).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    found = feats.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.first("y").alias("y"))
    rows = found.toPandas().sort_values("doc_id")
    x = np.stack(rows["features"].to_numpy()).astype(float) if len(rows) else np.zeros((0, FEATURES))
    return Network(FEATURES).fit(x, rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Null and empty texts are scored from zero features; without labels of both kinds every score is the share of label
    1 (0.5 without any). Each row gives a row; columns other than doc_id and text are ignored; a null doc_id is not held
    out.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    vectors = word_vectors(word_table(docs))
    feats = scratch.save("features", features(docs, vectors))
    network = fit_network(feats, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["features"].to_numpy()).astype(float) if len(b) else np.zeros((0, FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": network.score(x)})

    scored = feats.mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
