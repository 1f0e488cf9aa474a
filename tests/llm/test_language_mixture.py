import random
import zlib

import numpy as np

from tessera.llm import language_mixture as M

SOUNDS = {"aa": "aeiouklmnp", "bb": "bcdfghrstz", "cc": "vwxyzqjuio"}


def word(rng, lang):
    return "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 8)))


def corpus(n=240):
    rng = random.Random(9)
    langs = list(SOUNDS)
    return [(k, " ".join(word(rng, langs[k % 3]) for _ in range(rng.randint(3, 60))), langs[k % 3]) for k in range(n)]


def test_held_out(spark, documents):
    rows = corpus()
    got = {r.doc_id: r for r in M.identify(documents([*rows, (900, None, "aa"), (901, "", "aa"), (902, "123 ... _ ²", "bb"), (903, "KLMNP aeiou", None), (None, "aeio klmn", "aa")])).collect()}
    held = [i for i in got if i is not None and i < 900 and got[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred in SOUNDS and 0 <= got[903].score <= 1


def test_held_out_labels_change_nothing(spark, documents):
    rows = corpus()
    other = [(i, t, "bb" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in M.identify(documents(x)).collect()) for x in (rows, other))
    assert a == b


def test_mixture(spark, documents):
    rng = random.Random(1)
    model = M.learn(documents(corpus()))
    mixed = " ".join([word(rng, "aa") for _ in range(60)] + [word(rng, "bb") for _ in range(40)])
    (r,) = M.predict(documents([(1, mixed)]), model).collect()
    share = {x.lang: x.share for x in r.proportions}
    assert r.lang_pred == "aa" and abs(share["aa"] - 0.6) < 0.06 and abs(share["bb"] - 0.4) < 0.06 and "cc" not in share
    (r,) = M.predict(documents([(1, " ".join(word(rng, "cc") for _ in range(50)))]), model).collect()
    assert r.lang_pred == "cc" and r.score == 1.0  # the penalty leaves one language


def plain_mixture(like, sizes):
    """Every document by itself in double precision: EM over all languages, then over every prefix of their order."""
    out, at = [], 0
    for n in sizes:
        x = like[:, at : at + n].astype(float)
        at += n

        def fit(inside, start, x=x, n=n):
            p = np.where(inside, start, 0.0)
            p /= p.sum()
            for _ in range(3000):
                r = x * p[:, None]
                p = (r / r.sum(0)).mean(1)
            return p, np.log((x * p[:, None]).sum(0)).sum()

        every, _ = fit(np.ones(len(x), bool), np.ones(len(x)))
        order, best = np.argsort(-every, kind="stable"), (-np.inf, None)
        for k in range(1, len(x) + 1):
            p, value = fit(np.isin(np.arange(len(x)), order[:k]), np.maximum(every, 1e-6))
            if (value := value - (k - 1) / 2 * np.log(n + 1)) <= best[0]:
                break
            best = value, p
        out.append(best[1])
    return np.array(out)


def test_em_and_sets_against_brute_force():
    rng = np.random.default_rng(5)
    sizes, columns = rng.integers(1, 120, 60), []
    for k, n in enumerate(sizes):
        langs = rng.permutation(5)[: 1 + k % 5]
        for _ in range(n):
            x = np.exp(-rng.exponential(6, 5))
            x[rng.choice(langs)] = 1
            columns.append(x)
    like = np.array(columns, np.float32).T
    got, want = M.infer(like, sizes), plain_mixture(like, sizes)
    assert np.abs(got - want).max() < 0.03 and ((got > 0.02) == (want > 0.02)).mean() > 0.99
    assert (np.sum(want > 0.02, 1) == 5).any()  # sets of five languages are found too


def test_ties_repeats_and_a_long_text(spark, documents):
    rng = random.Random(3)
    same = [(k, "zz yy", "aa" if k % 2 else "bb") for k in range(40)]  # no letter tells the two apart
    long = " ".join(word(rng, "aa") for _ in range(100_000))
    got = M.identify(documents([*same, (7, "zz yy", "aa"), (99, long, "aa")])).collect()
    assert len(got) == 42 and len({(r.lang_pred, r.score) for r in got if r.doc_id < 40}) == 1


def test_grams_against_brute_force():
    texts = ["Abc, de!", "", "x", "éa_b 12c"]
    g = M.Grams(texts)
    assert g.words.tolist() == [2, 0, 1, 3]
    one = M.Grams(["abc"])
    assert len(one.two) == len(one.three) == 3 and len(one.closing) == 1
    assert M.Grams(["abc de"]).counts().sum() == one.counts().sum() + M.Grams(["de"]).counts().sum()
    table = np.random.default_rng(0).normal(size=(2, M.BUCKETS)).astype(np.float32)
    like = M.Grams(["abc de"]).likelihoods(table)
    for k, w in enumerate(["abc", "de"]):
        h = M.Grams([w])
        ll = [t[h.two].sum() + t[h.three].sum() + t[h.closing].sum() for t in table]
        assert np.allclose(like[:, k], np.exp(np.array(ll) - max(ll)), rtol=1e-3)


def test_keep_identified_and_empty(spark, documents):
    df = documents([*corpus(60), (900, None), (901, "12 %"), (None, "aeio klmn")])
    kept = M.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 61
    assert M.identify(documents([])).count() == 0
    assert [r.lang_pred for r in M.identify(documents([(2, "words", None)])).collect()] == ["und"]
