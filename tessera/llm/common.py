"""What the corpus operators share: scratch tables, word hashing and row identity."""

from __future__ import annotations

import ctypes
import gc
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


#: Rows of a batch where the session keeps Spark's default (the second number); whole texts are long rows, and a batch of
#: Parquet's reader is one array.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (1000, "10000"), "spark.sql.parquet.columnarReaderBatchSize": (512, "4096")}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Few rows in a batch while a job runs, unless the session has numbers of its own; afterwards the session is as it was."""
    before = {key: spark.conf.get(key) for key, (_, default) in BATCHES.items() if spark.conf.get(key) == default}
    for key in before:
        spark.conf.set(key, BATCHES[key][0])
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_kept: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """make(*args), made once for all tasks of a worker. A worker keeps one such thing."""
    key = (make, args)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make(*args)
    return _kept[key]


def let_go() -> None:
    """Drop what this worker keeps."""
    _kept.clear()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than GNU's
    _trim = None


def give_back() -> None:
    """Return to the system what this worker has freed; its allocators would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(step: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A stage's function over batches, for workers that live on beside the memory of stages that need no Python: a task
    drops what another stage kept, unless it keeps things itself, and ends by returning what it freed."""

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            let_go()
        yield from step(batches)
        give_back()

    return run


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make a session fit for Python stages: this package on the workers' path, shipped once an application through the
    shared folder."""
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        fs, folder = filesystem(shared_dir(spark))
        fs.create_dir(folder, recursive=True)
        name = f"tessera-{uuid.uuid4().hex}.zip"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            out.write(packed.getvalue())
        spark.sparkContext.addPyFile(f"{shared_dir(spark)}/{name}")
        _shipped.add(spark.sparkContext.applicationId)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Python tasks read and write themselves."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one under the warehouse, and
    only if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_scratch"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_folders: list[str] = []


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch tables of this process, or those made since there were so many; DataFrames that read them can't be
    run any more."""
    while len(_folders) > since:
        fs, folder = filesystem(_folders.pop())
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written to a scratch table; what scratch tables it needed on the way are removed."""
    out = Scratch(spark, name)
    since = len(_folders)
    df = out.save("result", make())
    clear_scratch(spark, since)
    return df


class Scratch:
    """Tables written to the shared folder, so that no later stage depends on one executor's disk."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _folders.append(self.root)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids and hashes of up to so many rows are broadcast (some 20 bytes a row); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """rows left-joined with keyed, which has one row a key and, as `weight`, its number of rows. Hot keys are joined by
    broadcast (share of them at most) and null keys not at all, so neither gathers in a task. Both sides are read more than once."""
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = keyed.where(F.col(weight) > total / share)
    few, rest = F.broadcast(hot), keyed.where(F.col(weight) <= total / share)
    out = rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").where(F.col(key).isNotNull()).join(rest, key, "left"))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def text_key(text: str = "text"):
    """16-byte identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


class WordIds(dict):
    """word -> 64-bit hash, remembered; emptied when it holds too many words."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(text: str | None, ids: WordIds) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (murmur3's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of runs of `width` words, sorted; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    h = np.full(n - w + 1, np.uint64(w))
    with np.errstate(over="ignore"):
        for j in range(w):
            h = mix(h * _MIX + hashes[j : n - w + 1 + j])
    return np.unique(h)
