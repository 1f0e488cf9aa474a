"""Token ids in binary files: a shared zstandard dictionary, one frame a document, an offset index for short reads.

A shard file is: MAGIC, sha256 of the dictionary (32 bytes), the frames, the zstd-compressed index (a record a document:
doc_id, null flag, offset, length, tokens), and a footer with the index's place, the counts and the index's crc32. The
dictionary is a file of its own, named by its hash. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, kept, lean, prepare, shared_dir, small_batches

MAGIC = b"TSRTOK01"
FOOTER = struct.Struct("<QQQQI4s")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u8")])
#: The dictionary is trained on the first PIECE ids of the SAMPLE documents with the smallest doc_ids; it serves
#: compression alone, never what is stored. So does the number of shards, from their mean length.
SAMPLE, PIECE, DICT_BYTES, LEVEL = 2000, 2048, 65536, 3
SHARD_CHARS = 32 << 20
#: Quantiles asked of one aggregate; where there are more shards, each range between them has its own.
QUANTILES = 4096
#: So many texts of a batch of the sample are compared.
COMPARED = 100
#: Texts whose ids by chunks are compared with their whole encoding before a tokenizer's chunks are trusted.
PROBES = (
    "One word, two words; 3 words: 4.5 and -6!",
    "one line\nanother Line\n3rd, line. last\n(line)",
    " a leading space and a trailing one ",
    "lines\nend here\n\nand (there) \"quoted\" 'single' it's we'll\r\n\ttabs",
    "Ünïcödé straße ελληνικά русский 中文字 日本語 \U0001f600 e\u0301",
    "snake_case camelCase UPPER x=y+1; f(x)[0]{k:'v'} a/b\\c #tag @me 100% $5 <b>&amp;</b> ~^|`",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa . ... !!! --",
    "nul\x00 bell\x07 nbsp\u00a0x thin\u2009y zero\u200bwidth",
    ".",
)
SPECIAL = "<|endoftext|>"
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


#: A chunk that may be encoded in one go with others: no white space but a line feed in front.
SOLID = re.compile(r"\n?\S+")
#: Bytes of text whose chunks are looked up together, by rows of so many.
PORTION, ROWS = 4 << 20, 1000


class Chunks(dict):
    """chunk -> its ids' bytes: a chunk follows a space, or begins with a line feed that it then includes. No bytes mark a
    chunk that other white space touches, whose ids depend on its neighbours.

    Of two generations the younger takes what is new or met again; when it is full, the elder is dropped, so chunks in
    use stay and memory is bounded."""

    LIMIT, LONGEST, TOGETHER = 450_000, 64, 100

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.limit, self.elder = tokenizer, self.LIMIT, {}
        vocabulary = tokenizer.get_vocab()
        self.spaced, self.feeds = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the vocabulary's mark of a space
        self.feeds[vocabulary["\u010a"]] = True  # and its line feed
        self.feed = struct.pack("<I", vocabulary["\u010a"])

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or body[0].isspace() or body[-1].isspace():
            return b""
        ids = self.elder.get(chunk) or (self.encode(" " + chunk) if body is chunk else self.feed + self.encode(body))
        if len(chunk) <= self.LONGEST:
            self[chunk] = ids
        return ids

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. What is new is encoded, many in one go."""
        found = list(map(self.get, chunks))
        at = [k for k, x in enumerate(found) if x is None]
        if at:
            self._learn([chunks[k] for k in at])
            for k in at:
                found[k] = self[chunks[k]]
        return found

    def _learn(self, new: list[str]) -> None:
        if len(self) >= self.limit:
            self.elder = dict(self)
            self.clear()
        if self.elder:
            old = {c: ids for c, ids in zip(new, map(self.elder.get, new)) if ids}
            self.update(old)
            new = [c for c in new if c not in old]
        new = [c for c in new if len(c) <= self.LONGEST and SOLID.fullmatch(c)]
        self._together([c for c in new if c[0] != "\n"], " ", self.spaced)
        self._together([c[1:] for c in new if c[0] == "\n"], "\n", self.feeds)

    def _together(self, bodies: list[str], mark: str, starts: np.ndarray) -> None:
        """Encode chunks in one go, in short runs with the mark in front of each; with it, a chunk starts at each id in
        `starts`."""
        front, encode, out = "" if mark == " " else mark, self.tokenizer.encode_batch_fast, {}
        for k in range(0, len(bodies), self.TOGETHER):
            part = bodies[k : k + self.TOGETHER]
            (e,) = encode([mark + mark.join(part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = [*np.flatnonzero(starts[ids]).tolist(), len(ids)]
            if len(cuts) == len(part) + 1:
                raw = ids.tobytes()
                out.update([(front + w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:])])
        self.update(out)


class Encoder:
    """Ids of whole texts. Where a vocabulary's pattern always breaks in front of a single space between other characters,
    and around a single line feed between them, the chunks between such breaks are encoded by themselves and remembered.
    Whether it does is tried on PROBES; another tokenizer encodes every text whole."""

    def __init__(self, tokenizer_path: str, end_id: int, chunked: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(tokenizer_path), struct.pack("<I", end_id)
        try:
            self.chunks = Chunks(self.tokenizer) if chunked else None
        except KeyError:  # no byte-level marks of a space and a line feed
            self.chunks = None
        if self.chunks is not None and not self.agrees(PROBES):
            self.chunks = None

    def agrees(self, texts: Sequence[str]) -> bool:
        """Whether chunks give what whole texts give."""
        return self.chunks is None or self.ids(list(texts)) == [self.whole(t) + self.end for t in texts]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def slowly(self, text: str) -> bytes:
        """Ids of a text in which white space meets white space."""
        head, *parts = LONE_SPACE.split(text)
        out = [self.whole(head)]
        for p in parts:
            ids = self.chunks[p] if p[:1] != "\n" else b""
            out.append(ids or self.whole(" " + p))
        return b"".join(out)

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Serialized ids with the end id; a null text counts as empty."""
        gc.disable()  # many lists of strings and no cycles
        try:
            return self._ids(texts)
        finally:
            gc.enable()

    def _ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if self.chunks is None:
            return [self.whole(t) + self.end if t else self.end for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        out = [self.end] * len(texts)
        special, filled = pc.match_substring(texts, SPECIAL), pc.greater(pc.binary_length(texts), 0)
        for k in pc.indices_nonzero(special).to_pylist():
            out[k] = self.whole(texts[k].as_py()) + self.end
        at = pc.indices_nonzero(pc.and_not(filled, special))
        if len(at):
            for k, ids in zip(at.to_pylist(), self._chunked(texts.take(at))):
                out[k] = ids
        return out

    def _chunked(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts that are not empty: each distinct chunk is looked up once, all places are filled by arrays."""
        # a line feed goes in front of each text, so that its first chunk is one of a line; its id is cut off again
        feed, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        split = pc.split_pattern(pc.binary_join_element_wise(feed, pc.replace_substring(texts, "\n", " \n"), nothing), " ")
        coded = split.flatten().dictionary_encode()
        distinct, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        bounds = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        found = self.chunks.of(distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, froms = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        taken = sizes[places]
        slow = np.logical_or.reduceat(taken == 0, bounds[:-1]).tolist()
        ends = np.cumsum(taken)
        cuts = (np.append(0, ends)[bounds] * 4).tolist()
        at = np.repeat(froms[places] - ends + taken, taken)
        at += np.arange(len(at))
        raw = memoryview(flat[at]).cast("B")
        for k, (a, b, by_hand) in enumerate(zip(cuts, cuts[1:], slow)):
            yield self.slowly(texts[k].as_py()) + self.end if by_hand else b"".join((raw[a + 4 : b], self.end))


def encoder_of(tokenizer_path: str, end_id: int, chunked: bool = True) -> Encoder:
    """One for all tasks of a worker, until a stage that needs none runs there."""
    return kept(Encoder, tokenizer_path, end_id, chunked)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_ids and texts of PORTION bytes or a little more, ROWS rows at least where there are as many."""
    held, size = [], 0
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.slice(k, ROWS)
            held.append((part["doc_id"], part["text"].cast(pa.large_string())))
            size += pc.sum(pc.binary_length(part["text"])).as_py() or 0
            if size >= PORTION:
                yield tuple(pa.concat_arrays(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held))


def shard_bounds(ids: DataFrame, shards: int) -> np.ndarray:
    """shards - 1 ascending quantiles of doc_id, null ones counted as the least number. An id that holds more rows than a
    shard comes several times."""
    known = ids.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"))
    top = min(shards, QUANTILES)
    at = lambda n: [k / n for k in range(1, n)]
    cuts = known.agg(F.percentile_approx("doc_id", at(top) or [0.5], 100_000)).first()[0] or []
    if shards <= 1:
        return np.zeros(0, np.int64)
    if shards <= QUANTILES:
        return np.array(cuts, np.int64)
    each = -(-shards // QUANTILES)
    between = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id")))
    inner = known.groupBy(between.alias("range")).agg(F.percentile_approx("doc_id", at(each), 10_000).alias("cuts")).collect()
    return np.sort(np.concatenate([np.array(cuts, np.int64), *[np.array(r.cuts, np.int64) for r in inner]]))


LEAST_ID = -(1 << 63)


def shards_of(ids: np.ndarray, bounds: np.ndarray, frames: list[bytes]) -> np.ndarray:
    """The shard of each document, in ascending order of ids; a document whose id takes several shards goes to one of them
    by its frame."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    out = high.astype(np.int32)
    for k in np.flatnonzero(high - low > 1):
        out[k] = low[k] + zlib.crc32(frames[k]) % int(high[k] - low[k] + 1)
    return out


def train_dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the pieces themselves as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(pieces)[-DICT_BYTES:]).ljust(16, b"\0")


class ShardWriter:
    """Frames in the order they come; the file appears under its name only when it is whole, so a task may be run again."""

    def __init__(self, folder: str, shard: int, dict_hash: bytes):
        self.fs, self.folder = filesystem(folder)
        self.shard, self.entries, self.at = shard, [], len(MAGIC) + 32
        self.part = f"{self.folder}/.{shard:06d}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC + dict_hash)

    def add(self, doc_id: int | None, frame: bytes, tokens: int) -> None:
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is None, self.at, len(frame), tokens))
        self.at += len(frame)

    def close(self) -> tuple[int, int, int]:
        index = np.array(self.entries, INDEX)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(index.tobytes())
        tokens = int(index["tokens"].sum())
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(packed), len(index), tokens, zlib.crc32(packed), b"END1"))
        self.out.close()
        final = f"{self.folder}/{self.shard:06d}.tok"
        if self.fs.get_file_info(final).type != pafs.FileType.NotFound:  # an earlier attempt of this task wrote the same
            self.fs.delete_file(final)
        self.fs.move(self.part, final)
        return self.shard, len(index), tokens


class ShardReader:
    """Reads any document by its place: the index, then the bytes of one frame."""

    def __init__(self, folder: str, shard: int, dictionary: bytes):
        fs, folder = filesystem(folder)
        self.file = fs.open_input_file(f"{folder}/{shard:06d}.tok")
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"shard {shard}: not a token file, or made with another dictionary")
        at, size, docs, self.tokens, crc, end = FOOTER.unpack(self.file.read_at(FOOTER.size, self.file.size() - FOOTER.size))
        packed = self.file.read_at(size, at)
        if end != b"END1" or zlib.crc32(packed) != crc:
            raise ValueError(f"shard {shard}: damaged index")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), INDEX)
        assert len(self.index) == docs
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> bytes:
        e = self.index[k]
        return self.unpack.decompress(self.file.read_at(int(e["length"]), int(e["offset"])), max_output_size=4 * int(e["tokens"]) + 16)

    def frames(self, first: int, last: int) -> Iterator[bytes]:
        """Ids of documents first to last - 1 by one read."""
        part = self.index[first:last]
        low = int(part["offset"][0])
        raw = self.file.read_at(int(part["offset"][-1]) + int(part["length"][-1]) - low, low)
        for e in part:
            a = int(e["offset"]) - low
            yield self.unpack.decompress(raw[a : a + int(e["length"])], max_output_size=4 * int(e["tokens"]) + 16)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Encode every whole text, append end_id, write shard files in ascending doc_id order.

    Returns the folder and, for each shard, (shard, documents, tokens). Null texts count as empty; null doc_ids come
    first; rows with equal doc_ids stand next to each other in the order of their frames; columns other than doc_id and
    text are ignored; an empty table gives no shards. Shards hold ranges of doc_id of about 32 million characters each, a
    task each, streamed to its file, so memory holds a batch and the shard's index; the rows of an id that outgrows a shard
    are spread over several. Chunks are remembered only if they give what whole texts give, on PROBES and on the sample.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.select("doc_id")
    least = [r.doc_id for r in ids.where("doc_id is not null").orderBy("doc_id").limit(SAMPLE).collect()]
    first = docs.where(F.col("doc_id") <= (least[-1] if least else 0)).select("text").limit(2 * SAMPLE)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path, end_id)
        for b in batches:
            texts = b["text"].tolist()
            agrees = encoder.agrees([t[:PIECE] for t in texts[:COMPARED] if t])
            yield pd.DataFrame({"piece": [x[: 4 * PIECE] for x in encoder.ids(texts)], "size": [len(t or "") for t in texts], "agrees": agrees})

    with small_batches(spark):
        sample = first.mapInPandas(lean(pieces, keeps=True), "piece binary, size long, agrees boolean").collect()
    chunked = all(r.agrees for r in sample)
    mean = sum(r["size"] for r in sample) / len(sample) if sample else 0
    shards = max(1, math.ceil(mean * ids.count() / SHARD_CHARS))
    bounds = shard_bounds(ids, shards)
    shards = len(bounds) + 1
    dictionary = train_dictionary(sorted(bytes(r.piece) for r in sample))
    digest = hashlib.sha256(dictionary).digest()
    with fs.open_output_stream(f"{path}/{digest.hex()}.dict") as out:
        out.write(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, chunked)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for ids, texts in portions(batches):
            raw = encoder.ids(texts)
            frames = [pack.compress(r) for r in raw]
            shard = shards_of(ids.fill_null(LEAST_ID).to_numpy(zero_copy_only=False), bounds, frames)
            tokens = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(tokens), pa.array(frames, pa.binary())], ["shard", "doc_id", "tokens", "frame"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, writer = [], None
        for b in batches:
            for shard, i, tokens, frame in zip(b["shard"], b["doc_id"].astype("Int64"), b["tokens"], b["frame"]):
                if writer is None or writer.shard != shard:
                    if writer:
                        done.append(writer.close())
                    writer = ShardWriter(folder, int(shard), digest)
                writer.add(None if i is pd.NA else int(i), frame, int(tokens))
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["shard", "docs", "tokens"])

    encoded = docs.mapInArrow(lean(encode, keeps=True), "shard int, doc_id long, tokens long, frame binary")
    ordered = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
    with small_batches(spark):
        written = ordered.mapInPandas(lean(write), "shard int, docs long, tokens long").collect()
    return folder, sorted((r.shard, r.docs, r.tokens) for r in written)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digest(spark, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    starts = np.cumsum([0] + [t for *_, t in shards])
    tasks = spark.createDataFrame([(s, int(a)) for (s, *_), a in zip(shards, starts)], "shard int, start long")
    fs, path = filesystem(folder)
    (name,) = (f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".dict"))
    dict_name = name.rpartition("/")[2]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        with fs.open_input_stream(f"{path}/{dict_name}") as f:
            dictionary = f.read()
        for b in batches:
            for shard, start in zip(b["shard"], b["start"]):
                reader = ShardReader(folder, int(shard), dictionary)
                for k in range(0, len(reader.index), 1000):
                    part = reader.index[k : k + 1000]
                    n = part["tokens"].astype(np.int64)
                    crc = [zlib.crc32(x) for x in reader.frames(k, k + len(part))]
                    ids = pd.array(part["doc_id"].astype(np.int64), "Int64")
                    ids[part["null"] == 1] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})
                    start += int(n.sum())

    return tasks.repartition(max(1, len(shards))).mapInPandas(lean(read), DIGEST)
