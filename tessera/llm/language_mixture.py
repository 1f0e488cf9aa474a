"""Language identification by mixtures: expectation-maximisation finds each document's language proportions from n-gram
likelihoods of its words, and a penalised likelihood selects the set of languages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, prepare, small_batches, small_side

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: A document's proportions are settled when no step moves one by more than this.
SETTLED = 1e-3
#: What a language of proportion 0 starts with where a larger set is tried.
LITTLE = 1e-6
UNDETERMINED = "und"
#: Characters handled together.
CHUNK = 250_000


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Letters of some whole texts, lower-cased and parted by boundaries, with hashed 2- and 3-grams at each letter."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(f"\n{t.lower()}".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        c = np.concatenate([*raw, np.zeros(1, np.uint32)])
        alpha = letters()[c]
        c = np.where(alpha, c, np.uint32(0))
        self.at = np.flatnonzero(alpha)
        before, here, after = (c[self.at + k].astype(np.uint64) for k in (-1, 0, 1))
        two = (before << np.uint64(21) | here) * np.uint64(0x9E3779B97F4A7C15)
        last = (here << np.uint64(21) | np.uint64(0x1FFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        three = (two ^ after) * np.uint64(0xC2B2AE3D27D4EB4F)
        shift = np.uint64(64 - BUCKET_BITS)
        self.two, self.three = (two >> shift).astype(np.int64), (three >> shift).astype(np.int64)
        #: The closing boundary's 2-gram, at each word's last letter.
        self.ends = np.flatnonzero(after == 0)
        self.closing = (last >> shift).astype(np.int64)[self.ends]
        #: Each word's first letter among the letters, and how many words each text has.
        self.starts = np.flatnonzero(before == 0)
        text = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
        self.words = np.bincount(text[self.at[self.starts]], minlength=len(texts)) if len(self.at) else np.zeros(len(texts), int)

    def counts(self) -> np.ndarray:
        return sum(np.bincount(x, minlength=BUCKETS) for x in (self.two, self.three, self.closing))

    def likelihoods(self, log_p: np.ndarray) -> np.ndarray:
        """(languages, words): each word's likelihood, scaled so that its largest is 1."""
        out = np.empty((len(log_p), len(self.starts)), np.float32)
        for k, table in enumerate(log_p):
            each = table[self.two] + table[self.three]
            each[self.ends] += table[self.closing]
            out[k] = np.add.reduceat(each, self.starts)
        return np.exp(np.maximum(out - out.max(0), -30))


def in_chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of about CHUNK characters together."""
    first, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK:
            yield first, texts[first : k + 1]
            first, n = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over whole texts of rows with a lang: each task counts n-grams by language in fixed tables."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, texts in in_chunks(part["text"].tolist()):
                    table += Grams(texts).counts()
        for lang, table in tables.items():
            (at,) = table.nonzero()
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": table[at]})

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInPandas(lean(count), "lang string, gram int, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods of n-grams by language; its size is BUCKETS times the number of languages."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        table = np.zeros((BUCKETS, len(self.langs)))
        table[counts["gram"].to_numpy(int), [self.langs.index(x) for x in counts["lang"]]] = counts["n"]
        table += SMOOTHING
        self.log_p = np.ascontiguousarray(np.log(table / table.sum(0)).T, np.float32)


def learn(docs: DataFrame) -> Model:
    prepare(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return Model(gram_counts(docs).toPandas())


def em(like: np.ndarray, sizes: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, documents) proportions when they have settled, and each document's log-likelihood. like: (languages,
    words), a document's words standing together, `sizes` of them. Languages with proportion 0 stay out. Documents that
    have settled leave the sums."""
    pi, active, part, held = pi.copy(), np.arange(len(sizes)), like, sizes
    while len(active):
        starts = np.cumsum(held) - held
        r = part * np.repeat(pi[:, active], held, 1)
        r /= r.sum(0)
        new = np.add.reduceat(r, starts, 1) / held.astype(np.float32)
        moving = np.abs(new - pi[:, active]).max(0) > SETTLED
        pi[:, active] = new
        if not moving.all():
            part = part[:, np.repeat(moving, held)]
            active, held = active[moving], held[moving]
    fit = (like * np.repeat(pi, sizes, 1)).sum(0)
    return pi, np.add.reduceat(np.log(fit), np.cumsum(sizes) - sizes)


def infer(like: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions by document in the language set whose log-likelihood less (free parameters / 2) log(words) is largest.

    Sets grow in the order of the proportions among all languages, as long as the penalised likelihood rises; no size is
    ruled out. All languages together fit best, so a document whose likelihood with all of them, less the penalty of one
    language more, is no better than what it has needs no larger set.
    """
    n_langs, price = len(like), np.log(sizes + 1) / 2
    every, ceiling = em(like, sizes, np.full((n_langs, len(sizes)), 1 / n_langs, np.float32))
    rank = np.argsort(np.argsort(-every, 0, kind="stable"), 0, kind="stable")
    best = (rank == 0).astype(np.float32)
    top, starts = every.argmax(0), np.cumsum(sizes) - sizes
    value = np.add.reduceat(np.log(np.maximum(like[np.repeat(top, sizes), np.arange(like.shape[1])], 1e-30)), starts)
    open_ = np.ones(len(sizes), bool)
    for k in range(2, n_langs + 1):
        open_ &= ceiling - (k - 1) * price > value
        (docs,) = open_.nonzero()
        if not len(docs):
            break
        inside = np.where(rank[:, docs] < k, np.maximum(every[:, docs], LITTLE), 0).astype(np.float32)
        got, fit = em(like[:, np.repeat(open_, sizes)], sizes[docs], inside / inside.sum(0))
        fit = fit - (k - 1) * price[docs]
        better = fit > value[docs]
        best[:, docs[better]], value[docs[better]] = got[:, better], fit[better]
        open_[docs[~better]] = False
    return best.T


def label_texts(texts: list[str], model: Model) -> Iterator[tuple[int, tuple[str, float, list[tuple[str, float]]]]]:
    """(place, (language, its proportion, the set's languages and proportions)) of each text that has letters."""
    for first, part in in_chunks(texts if model.langs else []):
        grams = Grams(part)
        (full,) = grams.words.nonzero()
        if len(full):
            for k, p in zip(full, infer(grams.likelihoods(model.log_p), grams.words[full])):
                order = np.argsort(-p, kind="stable")[: int((p > 0).sum())]
                shares = [(model.langs[at], float(min(1.0, p[at]))) for at in order]
                yield first + k, (*shares[0], shares)


PREDICTED = "doc_id long, lang_pred string, score double, proportions array<struct<lang:string,share:double>>"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, proportions (language and share, the largest first) for every whole text.

    lang_pred is the language with the largest proportion in the selected set, score that proportion; `und` with score
    0 where the text is null or has no letter, or where no language was learned. Ties go to the earlier language. Each
    row gives a row, equal rows equal ones; texts are whole, however long; other columns are ignored.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = [(UNDETERMINED, 0.0, None)] * len(b)
            for at, found in label_texts([t or "" for t in b["text"]], model):
                out[at] = found
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "proportions": [x[2] for x in out]}
            )

    return docs.select("doc_id", "text").mapInPandas(lean(label), PREDICTED)


def fold(modulus: int):
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def identify(docs: DataFrame) -> DataFrame:
    """predict() by a model learned from the rows whose fold by 4 is not 2, with held_out beside. A null doc_id is in no
    fold: such rows are not learned from and not held out."""
    model = learn(docs.where(fold(4) != 2))
    return predict(docs, model).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told. Only the rejected rows' ids and text hashes come back from
    Python, so texts are read and not moved."""
    scratch = Scratch(docs.sparkSession, "languages")
    mark = F.xxhash64("text").alias("#text")
    model = learn(docs.where(fold(4) != 2))

    def reject(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = np.zeros(len(b), bool)
            for at, _ in label_texts([t or "" for t in b["text"]], model):
                known[at] = True
            yield pd.DataFrame({"#id": b["doc_id"].astype("Int64")[~known], "#text": b["#text"][~known]})

    gone = scratch.save("rejected", docs.select("doc_id", "text", mark).mapInPandas(lean(reject), "`#id` long, `#text` long").distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("#id")) & (F.xxhash64("text") == F.col("#text"))
    return docs.join(small_side(gone), same, "left_anti").select(docs.columns)
