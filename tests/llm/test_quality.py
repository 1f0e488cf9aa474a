import zlib

import numpy as np

from tessera.llm import quality as Q


def corpus(prose):
    good = [(k, prose(60)) for k in range(0, 300, 2)]
    bad = [(k, " ".join([w + " $ | $"] * 20)) for k, w in zip(range(1, 300, 2), prose(150).split())]
    return good + bad, [(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad]


def test_held_out(spark, documents, prose, monkeypatch):
    docs, labels = corpus(prose)
    lab = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.score_quality(documents([*docs, (1000, None), (1001, ""), (None, "x")]), lab).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {k: q for k, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.predicted == want[r.doc_id] for r in held if r.doc_id in want]) > 0.95


def test_held_out_labels_change_nothing(spark, documents, prose):
    docs, labels = corpus(prose)
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, t) for k, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r.doc_id, r.score) for r in Q.score_quality(documents(docs), spark.createDataFrame(x, schema)).collect()) for x in (labels, flipped))
    assert a == b


def test_repeated_rows_and_a_long_text(spark, documents, prose):
    """An id with two texts, given in either order, and equal rows; a text far longer than a chunk."""
    docs, labels = corpus(prose)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(0, "$ | $ other"), (0, docs[0][1]), (777, " ".join([prose(50)] * 4000))]
    a, b = (sorted((r.doc_id, r.score) for r in Q.score_quality(documents(x).coalesce(1), lab).collect()) for x in (docs + extra, extra[::-1] + docs))
    assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-6) and len(a) == len(docs) + 3


def test_no_labels_and_empty(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.score_quality(documents([(1, "a b"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert Q.score_quality(documents([]), none).count() == 0


def test_contexts_against_brute_force():
    rng = np.random.default_rng(3)
    ids, doc = rng.integers(0, 50, 200), np.sort(rng.integers(0, 5, 200))
    table = np.zeros(Q.WORDS * Q.DIMS)
    Q.add_contexts(table, ids, doc)
    places, signs = Q.index_vectors.cached
    want = np.zeros((Q.WORDS, Q.DIMS))
    for i in range(200):
        for j in range(max(0, i - Q.WINDOW), min(200, i + Q.WINDOW + 1)):
            if i != j and doc[i] == doc[j]:
                for k in range(Q.NONZERO):
                    want[ids[i], places[k][ids[j]]] += signs[k][ids[j]]
    assert np.allclose(table.reshape(want.shape), want)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = Q.Network(6).fit(x, y)
    p = net.score(x)
    for lo in (0.1, 0.4, 0.7):
        part = (p >= lo) & (p < lo + 0.2)
        assert abs(y[part].mean() - p[part].mean()) < 0.1
