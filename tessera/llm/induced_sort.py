"""External induced sorting of the suffixes of many short strings, with common-prefix values.

Suffixes whose first symbol is followed by a smaller rest are of type L, the others of type S; an S suffix after an L
suffix is a seed. The substrings between seeds are named in their order; the string of names is the same problem, a
third as large, and is sorted by the same induction, and so on until the names tell all apart. Then two scans induce all
other suffixes: each suffix that is taken in order puts its predecessor behind those already waiting at the predecessor's
first symbol. What waits, and what the first scan hands to the second, is a priority queue keyed by (symbol, order of
arrival): first in, first out at each symbol. Its tuples of position and common-prefix value live in files; a stated
number of them is in memory. The second scan's result is a stream. The common prefix of two neighbours in a queue is one
more than the least value scanned between their origins. The text, a type a symbol and the names are held in arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

CAP = 250  # common-prefix values are kept up to this
SYMBOLS = 257  # byte + 1; 0 parts the strings


class Spool:
    """At most `limit` tuples in memory over all its queues, the others in files of `folder`, one a spill; without a place
    everything stays in memory. peak: the most that there were."""

    def __init__(self, limit: int, place=None):
        self.limit, self.place, self.held, self.peak, self.queues, self.spills = limit, place, 0, 0, [], 0

    def add(self, n: int) -> None:
        self.held += n
        self.peak = max(self.peak, self.held)
        if self.place and self.held > self.limit:
            for q in self.queues:
                q.spill()

    @property
    def chunk(self) -> int:
        """Tuples of one read."""
        return max(1, self.limit // 8)


class Queues:
    """First-in-first-out queues of (position, common prefix), a queue a symbol."""

    def __init__(self, spool: Spool):
        self.spool = spool
        self.parts: list[list] = [[] for _ in range(SYMBOLS)]  # arrays, or (file, tuples of the file, first, end)
        spool.queues.append(self)

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        for k in range(0, len(positions), self.spool.chunk):
            part = positions[k : k + self.spool.chunk], prefixes[k : k + self.spool.chunk]
            self.parts[symbol].append(part)
            self.spool.add(len(part[0]))

    def spill(self) -> None:
        live = [(s, k) for s, parts in enumerate(self.parts) for k, p in enumerate(parts) if len(p) == 2]
        if not live:
            return
        fs, folder = self.spool.place
        name = f"{folder}/{uuid.uuid4().hex}"
        n = sum(len(self.parts[s][k][0]) for s, k in live)
        with fs.open_output_stream(name) as out:
            for column, kind in ((0, np.int64), (1, np.uint8)):
                for s, k in live:
                    out.write(self.parts[s][k][column].astype(kind, copy=False).tobytes())
        file, at = fs.open_input_file(name), 0
        for s, k in live:
            m = len(self.parts[s][k][0])
            self.parts[s][k] = (file, n, at, at + m)
            at += m
        self.spool.held -= n
        self.spool.spills += 1

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            self.spool.held -= len(part[0])
            return part
        file, n, low, high = part
        return np.frombuffer(file.read_at(8 * (high - low), 8 * low), np.int64), np.frombuffer(file.read_at(high - low, 8 * n + low), np.uint8)

    def take(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest (or the newest) tuples that wait at a symbol, several small parts together."""
        parts, out, n = self.parts[symbol], [], 0
        while parts and (not out or n + self._size(parts[-1 if last else 0]) <= self.spool.chunk):
            out.append(self._load(parts.pop(-1 if last else 0)))
            n += len(out[-1][0])
        if not out:
            return None
        out = out[::-1] if last else out
        return out[0] if len(out) == 1 else (np.concatenate([p for p, _ in out]), np.concatenate([v for _, v in out]))

    @staticmethod
    def _size(part) -> int:
        return len(part[0]) if len(part) == 2 else part[3] - part[2]


class Scan:
    """The running minima between pushes: for each symbol the least common prefix scanned since its last push."""

    def __init__(self, text: np.ndarray, queues: Queues):
        self.text, self.queues = text, queues
        self.least = np.full(SYMBOLS, -1, np.int16)  # -1: nothing was pushed yet, so the next one has no common prefix

    def feed(self, positions: np.ndarray, prefixes: np.ndarray, wanted: np.ndarray) -> None:
        """Take suffixes in order and push the predecessors for which `wanted` holds."""
        if not len(positions):
            return
        at = np.flatnonzero(wanted)
        symbols = self.text[positions[at] - 1]
        order = np.argsort(symbols, kind="stable")
        cuts = np.flatnonzero(np.diff(symbols[order])) + 1
        before = self.least
        self.least = np.minimum(before, prefixes.min()).astype(np.int16)
        for group in np.split(order, cuts) if len(order) else []:
            s, hits = int(symbols[group[0]]), at[group]
            starts = np.concatenate([[0], hits + 1])
            ended = starts[-1] == len(prefixes)
            low = np.minimum.reduceat(prefixes, starts[:-1] if ended else starts).astype(np.int16)
            made = low if ended else low[:-1]
            made[0] = min(made[0], before[s])
            self.queues.put(s, positions[hits] - 1, np.minimum(made + 1, CAP).astype(np.uint8))
            self.least[s] = CAP if ended else low[-1]


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last symbol, a parting 0, is."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    nearest = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # the next place at which symbols differ
    s = np.ones(n, bool)
    inside = nearest < n - 1
    s[:-1][inside] = step[nearest[inside]] > 0
    return s


def runs(text: np.ndarray) -> np.ndarray:
    """How often the symbol at each place repeats from there on, up to CAP."""
    n = len(text)
    ends = np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)
    return np.minimum(np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n) + 1, CAP).astype(np.uint8)


def firsts(new: np.ndarray) -> np.ndarray:
    """For each place in a sorted order the place where its group of equals begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank)[rank] > 1


def names(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Ranks (the places where groups of equals begin) of the substrings from each seed to the next one, by symbols and
    types, as many at a time as a word takes; only what is still tied and goes on is looked at again."""
    bits = int(text.max()).bit_length() + 2
    width = max(1, 62 // bits)
    coded = np.append(text.astype(np.uint64) * np.uint64(2) + s_type, np.zeros(width, np.uint64))
    length = np.append(np.diff(seeds) + 1, 1)

    def chunk(rows: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j in range(width):
            inside = k + j < length[rows]
            at = np.minimum(seeds[rows] + k + j, len(coded) - 1)
            out = out << np.uint64(bits) | np.where(inside, coded[at] + np.uint64(1), np.uint64(0))
        return out

    every = np.arange(len(seeds))
    key = chunk(every, 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(seeds), np.int64)
    rank[order] = firsts(np.append(True, key[order][1:] != key[order][:-1]))
    k = width
    while True:
        tied = _tied(rank)
        rows = np.flatnonzero(tied & np.isin(rank, rank[tied & (length > k)]))
        if not len(rows):
            return rank
        _split(rank, rows, chunk(rows, k))
        k += width


def _split(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Refine, in place, the ranks of rows, which are whole groups of equals, by key."""
    r = rank[rows]
    order = np.argsort(r << 32 | key) if key.dtype == np.int64 else np.lexsort((key, r))
    r, k = r[order], key[order]
    group = np.append(True, r[1:] != r[:-1])
    part = group | np.append(True, k[1:] != k[:-1])
    rank[rows[order]] = r + firsts(part) - firsts(group)


def seeds_of(text: np.ndarray, s_type: np.ndarray) -> np.ndarray:
    seed = s_type.copy()
    seed[0] = False
    seed[1:] &= ~s_type[:-1]
    return np.flatnonzero(seed)


def seed_order(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Seeds in the order of their suffixes: by their names, or, while some are equal, by the suffixes of the string of
    names."""
    rank = names(text, s_type, seeds)
    if not _tied(rank).any():
        return np.argsort(rank)
    return order_of_names(np.unique(rank, return_inverse=True)[1])


def order_of_names(text: np.ndarray) -> np.ndarray:
    """All suffixes of a string of numbers in order. Where one suffix begins another it comes first, so that a shorter rest
    counts as smaller; the last symbol of a shard's names, its last parting 0, is followed by nothing."""
    text = np.append(text + 1, 0)
    s_type = types(text)
    seeds = seeds_of(text, s_type)
    order = seeds[seed_order(text, s_type, seeds)]
    n = len(text)
    ends = np.cumsum(np.bincount(text))
    out = np.full(n, -1)
    symbols = text[order]
    behind = np.searchsorted(symbols, symbols, "right") - np.arange(len(order))
    out[ends[symbols] - behind] = order
    _induce(out, text, ~s_type, np.append(0, ends[:-1]))
    out[s_type[out] & (out >= 0)] = -1
    out[0] = n - 1
    _induce(out[::-1], text, s_type, n - ends)
    return out[1:]


def _induce(out: np.ndarray, text: np.ndarray, wanted: np.ndarray, heads: np.ndarray) -> None:
    """Take the suffixes in `out` from left to right and put each predecessor that is wanted at the head of its symbol's
    places. A block is taken at once as far as nothing in it is put into the block itself."""
    at, n, width = 0, len(out), 1024
    while at < n:
        end = min(n, at + width)
        p = out[at:end]
        rows = np.flatnonzero(p > 0)
        before = p[rows] - 1
        rows, before = rows[wanted[before]], before[wanted[before]]
        if len(rows):
            order = np.argsort(text[before], kind="stable")
            symbols = text[before][order]
            target = heads[symbols] + np.arange(len(order)) - firsts(np.append(True, symbols[1:] != symbols[:-1]))
            low = int(target.min())
            if low < end:
                end = low
                inside = rows[order] < end - at
                order, symbols, target = order[inside], symbols[inside], target[inside]
            out[target] = before[order]
            heads[symbols] = target + 1  # of equal symbols the last one counts
        width = min(1 << 16, 2 * width) if end - at == width else max(64, width // 2)
        at = end


class Prefixes:
    """Lengths of the common prefixes of suffix pairs, up to depth: seven symbols of nine bits a word."""

    def __init__(self, text: np.ndarray, depth: int):
        padded = np.append(text, np.zeros(depth + 14, text.dtype)).astype(np.uint64)
        self.depth, self.words = depth, np.zeros(len(padded) - 6, np.uint64)
        for j in range(7):
            self.words <<= np.uint64(9)
            self.words |= padded[j : len(self.words) + j]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(0, self.depth, 7):
            if not len(live):
                break
            off = self.words[a[live] + k] ^ self.words[b[live] + k]
            same = off == 0
            bits = np.frexp((off[~same] >> np.uint64(9 * 3)).astype(np.float64))[1]  # exact for what is left of the upper four
            low = np.frexp((off[~same] & np.uint64((1 << 27) - 1)).astype(np.float64))[1]
            top = np.where(bits > 0, bits + 27, low)
            out[live[same]] += 7
            out[live[~same]] += (63 - top) // 9
            live = live[same]
        return np.minimum(out, self.depth)


def join_strings(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, starts): the strings' symbols, each string closed by a 0, and where each one starts."""
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    text[starts + sizes - 1] = 0
    return text, starts


def descending(text: np.ndarray, depth: int, spool: Spool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, prefixes) of all suffixes from the largest to the smallest, by their first `depth` symbols at least; a
    prefix is the length that a suffix has in common with the next smaller one (exact up to depth)."""
    s_type = types(text)
    seeds = seeds_of(text, s_type)
    order = seeds[seed_order(text, s_type, seeds)]
    waiting, bucket, common = Queues(spool), np.searchsorted(text[order], np.arange(SYMBOLS + 1)), Prefixes(text, depth)
    for c in range(SYMBOLS):
        for low in range(bucket[c], bucket[c + 1], spool.chunk):
            part = order[low : min(low + spool.chunk, bucket[c + 1])]
            ahead = order[max(0, low - 1) : low - 1 + len(part)] if low else np.append(part[:1], part[:-1])
            waiting.put(c, part, common.of(ahead, part).astype(np.uint8))
    del order, seeds, common
    length = runs(text)

    large, queues = Queues(spool), Queues(spool)  # type L, ascending
    scan = Scan(text, queues)
    wants_l = lambda p: (p > 0) & ~s_type[p - 1]
    for c in range(SYMBOLS):
        last = None
        while (got := queues.take(c)) is not None:
            scan.feed(got[0], got[1], wants_l(got[0]))
            large.put(c, *got)
            last = got[0][-1]
        first = True
        while (got := waiting.take(c)) is not None:
            positions, prefixes = got[0], got[1].copy()
            if first:
                prefixes[0] = 0 if last is None else min(length[last], length[positions[0]])
                first = False
            scan.feed(positions, prefixes, wants_l(positions))

    queues = Queues(spool)
    scan = Scan(text, queues)
    wants_s = lambda p: (p > 0) & s_type[p - 1]
    # the last symbol's suffix is the first of all and no suffix's predecessor; it waits at its symbol's least place
    for c in range(SYMBOLS - 1, -1, -1):
        last = None
        while (got := queues.take(c)) is not None:  # a value stands between a suffix and the next larger one
            scan.feed(got[0], got[1], wants_s(got[0]))
            if last is None:
                yield got[0][:-1], got[1][1:]
            else:
                yield np.append(last, got[0][:-1]), got[1]
            last = got[0][-1]
        seam, first = 0, True
        while (got := large.take(c, last=True)) is not None:  # a value stands between a suffix and the next smaller one
            positions, prefixes = got
            if first:
                first = False
                seam = 0 if last is None else min(length[last], length[positions[-1]])
                if last is not None:
                    yield np.array([last]), np.array([seam], np.uint8)
            down = np.append(seam, prefixes[:0:-1]).astype(np.uint8)
            seam = prefixes[0]
            scan.feed(positions[::-1], down, wants_s(positions[::-1]))
            yield positions[::-1], prefixes[::-1]
        if first and last is not None:
            yield np.array([last]), np.zeros(1, np.uint8)


def induced_order(strings: list[bytes], depth: int, spool: Spool | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, prefixes, starts): the suffixes of the strings, parted by 0 symbols, in ascending order, each one's
    common prefix with its predecessor, and where each string starts."""
    text, starts = join_strings(strings)
    parts = list(descending(text, depth, spool or Spool(1 << 60)))
    return np.concatenate([p for p, _ in parts])[::-1].astype(np.int64), np.concatenate([v for _, v in parts])[::-1], starts
