"""Suffix-array deduplication: every byte covered by a 100-byte string that also starts earlier goes.

Equal 100-byte strings have the same least hashed 32-byte piece (the leftmost of equals), so the runs of string starts
that share one such anchor are the unit of work. Runs whose anchor occurs once in the corpus can't repeat. The others are
cut out of the texts as short contexts and dealt to shards by anchor. There equal contexts are merged, byte by byte, to
their earliest place, and the suffixes of contexts that share an anchor with another one are ordered by external induced
sorting: neighbours with a common prefix of 100 bytes or more are equal strings, of which the earliest stays. Hashes only
say what has to meet; bytes decide what goes. A shard that an anchor with many contexts would overfill takes its strings
one by one, dealt by their own bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, filesystem, mix, shared_dir, small_side
from tessera.llm.induced_sort import Spool, descending, join_strings

LENGTH, PIECE = 100, 32
WIDE = LENGTH - PIECE + 1  # pieces in a string
PLACE_BITS = 20
SEGMENT = (1 << PLACE_BITS) - 1024
FLUSH_RUNS = 1_500_000
BUCKET_BYTES, SHARD_BYTES = 16 << 20, 12 << 20
#: A shard of more than OVERFULL * SHARD_BYTES of contexts takes strings one by one.
OVERFULL = 4
#: Suffix tuples that a sort holds in memory; the others are in files of the shared folder.
QUEUE_TUPLES = 400_000

_RNG = np.random.default_rng(4711)
_BYTES = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("pos", "<i8"), ("n", "<i8")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


class Powers:
    """Powers of the base and of its inverse modulo 2^64, for prefix hashes; grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


_powers_held = Powers()


def runs_of(text: bytes) -> np.ndarray:
    """Runs of string starts with a common anchor: anchor's hash, hash of the run's bytes, first start, number of starts."""
    if len(text) < LENGTH:
        return np.zeros(0, RUN)
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    _powers_held.need(n + 1)
    up, down = _powers_held.up, _powers_held.down
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[:n], out=prefix[1:])
    h = mix((prefix[PIECE:] - prefix[:-PIECE]) * down[: n - PIECE + 1])
    out = []
    starts = n - LENGTH + 1
    for low in range(0, starts, SEGMENT):
        count = min(SEGMENT, starts - low)
        v = (h[low : low + count + WIDE - 1] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(count + WIDE - 1, dtype=np.uint64)
        width = 1
        while 2 * width <= WIDE:  # least of ever wider windows; the place in the low bits makes the leftmost win
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[: count], v[WIDE - width : WIDE - width + count])
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        part = np.zeros(len(first), RUN)
        part["key"] = v[first] >> np.uint64(PLACE_BITS)
        part["pos"], part["n"] = first + low, np.diff(np.append(first, count))
        ends = part["pos"] + part["n"] + LENGTH - 1
        part["ctx"] = mix((prefix[ends] - prefix[part["pos"]]) * down[part["pos"]])
        out.append(part)
    return np.concatenate(out)


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as 64-bit words, byte plane by byte plane, compressed."""
    raw = b"".join(np.ascontiguousarray(np.asarray(c).astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw]


def _utf8(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    if len(out):
        out[0] = True
    return out


RUNS = "bucket int, entries binary, doc_id long, gone binary, asked binary, n long"


def _doc_rows(doc: np.ndarray, column: str, *columns: np.ndarray) -> pd.DataFrame:
    ids, blobs = by_doc(doc, *columns)
    counts = np.unique(doc, return_counts=True)[1]
    return pd.DataFrame({"doc_id": ids, column: blobs, "n": counts})


def _frame(parts: list[pd.DataFrame], schema: str) -> pd.DataFrame:
    types = dict(c.split() for c in schema.split(", "))
    out = pd.concat([p.reindex(columns=list(types)) for p in parts], ignore_index=True) if parts else pd.DataFrame(columns=list(types))
    return out.astype({c: {"int": "Int32", "long": "Int64"}[t] for c, t in types.items() if t in ("int", "long")}).astype({c: object for c, t in types.items() if t == "binary"})


def find_runs(buckets: int):
    """Texts -> rows of a bucket (entries: one run of each anchor) and rows of a document (gone: runs whose bytes stand
    earlier in the same batch of texts; asked: runs that share their anchor with other bytes there).

    A batch sends an anchor once, whatever the number of its contexts, so a bucket holds no more entries of an anchor
    than there are batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, docs, texts, n = [], [], [], 0

        def settle() -> pd.DataFrame:
            ids = np.array(docs, np.int64)
            by_id = np.argsort(ids, kind="stable")  # runs come by pos within a text, so the stable sort needs neither
            r = np.concatenate([held[k] for k in by_id])
            raws = [texts[k] for k in by_id]
            text = np.repeat(np.arange(len(raws)), [len(held[k]) for k in by_id])
            order = np.lexsort((r["ctx"], r["key"]))
            r, text = r[order], text[order]
            doc = ids[by_id][text]
            first = _changes(r["key"], r["ctx"])
            head = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
            later = np.flatnonzero(~first)
            pos, end = r["pos"], r["pos"] + r["n"] + LENGTH - 1
            same = [raws[i][a:z] == raws[j][c:d] for i, a, z, j, c, d in zip(*(x.tolist() for x in (text[later], pos[later], end[later], text[head[later]], pos[head[later]], end[head[later]])))]
            gone = np.zeros(len(r), bool)
            gone[later[np.array(same, bool)]] = True
            parts = []
            if gone.any():
                parts.append(_doc_rows(doc[gone], "gone", pos[gone], r["n"][gone]))
            r, doc = r[~gone], doc[~gone]
            anchor = _changes(r["key"])
            many = np.diff(np.append(np.flatnonzero(anchor), len(r))) > 1
            shared = many[np.cumsum(anchor) - 1]
            if shared.any():
                parts.append(_doc_rows(doc[shared], "asked", r["pos"][shared], r["n"][shared], r["key"][shared]))
            into = np.flatnonzero(anchor)
            flags = many.astype(np.int64)
            bucket = r["key"][into] % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            into, flags, bucket = into[order], flags[order], bucket[order]
            cuts, rows = np.append(np.flatnonzero(_changes(bucket)), len(into)), []
            for a, z in zip(cuts, cuts[1:]):  # a bucket's entries in the order of their keys
                i = into[a:z]
                key = r["key"][i]
                rows.append((int(bucket[a]), pack(np.diff(key, prepend=key[:1] * 0), doc[i], r["pos"][i], r["n"][i] * 2 + flags[a:z])))
            parts.append(pd.DataFrame(rows, columns=["bucket", "entries"]))
            for x in (held, docs, texts):
                x.clear()
            return _frame(parts, RUNS)

        for b in batches:
            for i, text in zip(b["doc_id"], b["text"]):
                raw = _utf8(text)
                found = runs_of(raw)
                if len(found):
                    held.append(found)
                    docs.append(int(i))
                    texts.append(raw)
                    n += len(found)
                    if n >= FLUSH_RUNS:
                        yield settle()
                        n = 0
        if held:
            yield settle()

    return run


def by_doc(doc: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Columns packed a document."""
    order = np.argsort(doc, kind="stable")
    doc, columns = doc[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(_changes(doc)), len(doc))
    return doc[cuts[:-1]].tolist(), [pack(*[c[a:z] for c in columns]) for a, z in zip(cuts, cuts[1:])]


ASKED = "doc_id long, asked binary, n long"


def meet_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's entries -> the runs whose anchor occurs in another batch too and that their own batch didn't ask for."""
    columns = [unpack(e, 4) for e in rows["entries"]]
    key = np.concatenate([np.cumsum(c[0]) for c in columns])
    doc, pos, flagged = (np.concatenate([c[k] for c in columns]) for k in range(1, 4))
    n, many = flagged >> 1, flagged & 1
    _, group, held = np.unique(key, return_inverse=True, return_counts=True)
    ask = (held[group] > 1) & (many == 0)
    if not ask.any():
        return _frame([], ASKED)
    return _frame([_doc_rows(doc[ask], "asked", pos[ask], n[ask], key[ask])], ASKED)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(shards)


def shard_sizes(shards: int):
    """asked -> shard, bytes, starts: what the shards' contexts will hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                _, n, key = (np.concatenate(x) for x in zip(*(unpack(a, 3) for a in b["asked"])))
                shard, which = np.unique(shard_of(key, shards), return_inverse=True)
                yield pd.DataFrame({"shard": shard.astype(np.int64), "bytes": np.bincount(which, n + LENGTH - 1).astype(np.int64), "starts": np.bincount(which, n).astype(np.int64)})

    return run


CONTEXTS = "shard long, places binary, contexts binary, doc_id long, gone binary"


def cut_contexts(shards: int, overfull: np.ndarray, more: int):
    """doc_id, text, asked -> shard, places (doc_id, start, starts, key), contexts: the bytes of the runs that are asked
    for. Runs of overfull shards come string by string, in `more` further shards by their bytes; of strings that are
    equal in a batch the earliest is sent, and the others, as gone, go with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, pos, n, key, raws, which = [], [], [], [], [], []
            for k, (i, text, asked) in enumerate(zip(b["doc_id"], b["text"], b["asked"])):
                raws.append(_utf8(text))
                p, c, a = (np.concatenate(x) for x in zip(*(unpack(x, 3) for x in asked)))
                doc.append(np.full(len(p), int(i)))
                pos.append(p)
                n.append(c)
                key.append(a)
                which.append(np.full(len(p), k))
            if not doc:
                continue
            doc, pos, n, key, which = (np.concatenate(x) for x in (doc, pos, n, key, which))
            shard = shard_of(key, shards).astype(np.int64)
            rows, hot = [], np.isin(shard, overfull)
            if hot.any():
                k = np.repeat(np.flatnonzero(hot), n[hot])
                d, p, t = doc[k], pos[k] + np.arange(len(k)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot]), which[k]
                order = np.lexsort((p, d))
                d, p, t = d[order], p[order], t[order]
                seen: dict[bytes, int] = {}
                heads = _first_of(np.array([seen.setdefault(raws[x][y : y + LENGTH], len(seen)) for x, y in zip(t.tolist(), p.tolist())]))
                own = np.array([xxhash.xxh3_64_intdigest(s) for s in seen], np.uint64)
                for i, blob in zip(*by_doc(d[~heads], p[~heads], np.ones((~heads).sum(), np.int64))):
                    rows.append((shards + i % more, None, None, i, blob))
                strings = list(seen)
                into = shards + (own % np.uint64(more)).astype(np.int64)
                rows += _packed(into, d[heads], p[heads], np.ones(heads.sum(), np.int64), own.view(np.int64), strings)
            cold = ~hot
            ends = (pos + n + LENGTH - 1)[cold]
            parts = [raws[t][a:z] for t, a, z in zip(which[cold].tolist(), pos[cold].tolist(), ends.tolist())]
            rows += _packed(shard[cold], doc[cold], pos[cold], n[cold], key[cold], parts)
            yield _frame([pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXTS.split(", ")])], CONTEXTS)

    return run


def _first_of(ids: np.ndarray) -> np.ndarray:
    """Where each number occurs first."""
    out = np.zeros(len(ids), bool)
    out[np.unique(ids, return_index=True)[1]] = True
    return out


def _packed(shard, doc, pos, n, key, parts: list[bytes]) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    shard, doc, pos, n, key = (x[order] for x in (shard, doc, pos, n, key))
    cuts = np.append(np.flatnonzero(_changes(shard)), len(shard))
    compress = zstandard.ZstdCompressor(level=1).compress
    return [(int(shard[a]), pack(doc[a:z], pos[a:z], n[a:z], key[a:z]), compress(b"".join([parts[k] for k in order[a:z].tolist()])), None, None) for a, z in zip(cuts, cuts[1:])]


def sort_shard(spool_root: str, tuples: int):
    """A shard's contexts -> doc_id, gone: starts whose strings also start earlier, as runs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        passed = rows["gone"].notna()
        out = [rows.loc[passed, ["doc_id", "gone"]]]
        doc, pos, n, key, parts = [], [], [], [], []
        for places, contexts in zip(rows.loc[~passed, "places"], rows.loc[~passed, "contexts"]):
            d, p, k, a = unpack(places, 4)
            raw = zstandard.ZstdDecompressor().decompress(contexts)
            ends = np.cumsum(k + LENGTH - 1)
            parts += [raw[i:z] for i, z in zip((ends - k - LENGTH + 1).tolist(), ends.tolist())]
            for into, x in zip((doc, pos, n, key), (d, p, k, a)):
                into.append(x)
        if parts:
            doc, pos, n, key = (np.concatenate(x) for x in (doc, pos, n, key))
            order = np.lexsort((pos, doc))
            doc, pos, n, key, parts = doc[order], pos[order], n[order], key[order], [parts[k] for k in order.tolist()]
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(x, len(known)) for x in parts])
            first = _first_of(which)
            if not first.all():
                later = ~first
                out.append(pd.DataFrame(dict(zip(("doc_id", "gone"), by_doc(doc[later], pos[later], n[later])))))
            doc, pos, n, key, parts = doc[first], pos[first], n[first], key[first], list(known)
            _, group, held = np.unique(key, return_inverse=True, return_counts=True)
            ask = held[group] > 1  # a context alone at its anchor shares no string with another
            if ask.any():
                out.append(order_contexts(doc[ask], pos[ask], n[ask], [parts[k] for k in np.flatnonzero(ask).tolist()], spool_root, tuples))
        return pd.concat(out, ignore_index=True).astype({"doc_id": "int64"})

    return run


def order_contexts(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, parts: list[bytes], spool_root: str, tuples: int) -> pd.DataFrame:
    """doc_id, gone: of the strings of different contexts, those equal to one that starts earlier. Neighbours in the
    order come in chunks; of a group of equals only the earliest so far is carried from one to the next."""
    fs, root = filesystem(spool_root)
    folder = f"{root}/{uuid.uuid4().hex}"
    fs.create_dir(folder, recursive=True)
    text, starts = join_strings(parts)
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    places, gone = (rank << 32) + pos, []  # the earlier, the smaller
    carried = np.zeros(0, np.int64)
    try:
        for at, prefix in descending(text, LENGTH, Spool(tuples, (fs, folder))):
            if not len(at):
                continue
            which = np.searchsorted(starts, at, "right") - 1
            offset = at - starts[which]
            joined = np.append(bool(len(carried)), prefix[:-1] >= LENGTH)
            group = np.cumsum(~joined)
            whole = offset < n[which]
            when, group = np.append(carried, (places[which] + offset)[whole]), np.append(np.zeros(len(carried), np.int64), group[whole])
            new = _changes(group)
            least = np.minimum.reduceat(when, np.flatnonzero(new)) if len(when) else when
            gone.append(when[when != least[np.cumsum(new) - 1]])
            carried = least[-1:] if prefix[-1] >= LENGTH and whole[-1] else carried[:0]
    finally:
        fs.delete_dir(folder)
    when = np.sort(np.concatenate(gone)) if gone else carried[:0]
    first = _changes(when - np.arange(len(when)))
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(when)))
    ids, blobs = by_doc(doc[np.searchsorted(rank, when[at] >> 32)], when[at] & 0xFFFFFFFF, counts)
    return pd.DataFrame({"doc_id": ids, "gone": blobs})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_mask(size: int, gone) -> np.ndarray:
    """Which bytes are covered by removed strings."""
    edge = np.zeros(size + 1, np.int64)
    for blob in gone if gone is not None else ():
        pos, n = unpack(blob, 2)
        pos, end = np.minimum(pos, size), np.minimum(pos + n + LENGTH - 1, size)
        np.add.at(edge, pos, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text, gone in zip(b["doc_id"].astype("Int64"), b["text"], b["gone"]):
            raw = _utf8(text)
            if gone is None or not len(gone):
                rows.append((i, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            mask = removed_mask(len(raw), gone)
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            rows.append((i, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def repeated_starts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, gone (array of packed (start, count) runs): where strings start that also start earlier. texts has a row a
    doc_id."""
    spark = texts.sparkSession
    texts = texts.where("doc_id is not null and octet_length(text) >= " + str(LENGTH))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, -(-size // BUCKET_BYTES))
    runs = scratch.save("runs", texts.mapInPandas(find_runs(buckets), RUNS))
    met = runs.where("entries is not null").select("bucket", "entries").groupBy("bucket").applyInPandas(meet_runs, ASKED)
    asked = runs.where("asked is not null").select("doc_id", "asked", "n").unionAll(scratch.save("met", met))
    weight = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (LENGTH + (WIDE + 1) // 2)
    shards = max(32, -(-weight // SHARD_BYTES))
    sizes = asked.select("asked").mapInPandas(shard_sizes(shards), "shard long, bytes long, starts long").groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("starts").alias("starts"))
    hot = sizes.where(F.col("bytes") > OVERFULL * SHARD_BYTES).orderBy("shard").collect()  # a quarter of the shards at most
    more = max(1, -(-sum(r.starts for r in hot) * LENGTH // SHARD_BYTES))
    lists = asked.groupBy("doc_id").agg(F.collect_list("asked").alias("asked"))
    wanted = texts.join(small_side(scratch.save("wanted", lists.select("doc_id"))), "doc_id", "left_semi").join(lists, "doc_id")
    contexts = wanted.mapInPandas(cut_contexts(shards, np.array([r.shard for r in hot], np.int64), more), CONTEXTS)
    sorted_ = contexts.groupBy("shard").applyInPandas(sort_shard(f"{shared_dir(spark)}/spool", QUEUE_TUPLES), "doc_id long, gone binary")
    every = runs.where("gone is not null").select("doc_id", "gone").unionAll(scratch.save("found", sorted_))
    return every.groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs(doc_id, text).

    Texts are whole, as UTF-8 bytes, a null text empty; strings never cross documents, texts under 100 bytes keep all.
    Earlier means a smaller doc_id, or the same and an earlier start; strings are judged on the input. Repeated rows lose
    what one of them loses; of a doc_id with several texts the least takes part, and the others keep all and make nothing
    go. So does a row without a doc_id. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = scratch.save("several", docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if several.isEmpty():
        gone = repeated_starts(docs, scratch)
        return docs.join(gone, "doc_id", "left").mapInPandas(digest, RESULT)
    some = small_side(several)
    least = scratch.save("least", docs.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    gone = repeated_starts(docs.join(some, "doc_id", "left_anti").select("doc_id", "text").unionByName(least), scratch)
    one = least.select("doc_id", F.xxhash64("text").alias("one"))
    judged = docs.join(gone, "doc_id", "left").join(one, "doc_id", "left")
    return judged.withColumn("gone", F.when(F.col("one").isNull() | (F.col("one") == F.xxhash64("text")), F.col("gone"))).select("doc_id", "text", "gone").mapInPandas(digest, RESULT)


def without_repeats(text: str | None, gone) -> str | None:
    """The text that is left; a character that loses a byte goes whole."""
    if not text or gone is None:
        return text
    raw = _utf8(text)
    return np.frombuffer(raw, np.uint8)[~removed_mask(len(raw), gone)].tobytes().decode("utf-8", "ignore")
