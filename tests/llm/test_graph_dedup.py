import numpy as np
import pytest

from tessera.llm import graph_dedup as G


def brute(vectors, threshold=0.9):
    """links and least reachable id by all pairs."""
    ids = list(vectors)
    ok = {i: v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for i, v in vectors.items()}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in vectors.items() if ok[i]}
    near = {i: [j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= threshold] if ok[i] else [] for i in ids}
    least = {}
    for i in sorted(ids):
        if i not in least:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in least:
                    least[k] = i
                    stack += near[k]
    return {i: (len(near[i]), least[i], least[i] == i) for i in ids}


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int, rep int")


@pytest.fixture
def vectors():
    rng = np.random.default_rng(8)
    out, k = {}, 0
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            out[k] = (centre + rng.normal(size=16) * 0.12).astype(np.float32).tolist()
            k += 1
    for _ in range(25):  # equal vectors
        out[k] = out[3]
        k += 1
    out |= {k: None, k + 1: [0.0] * 16, k + 2: [float("nan")] + [1.0] * 15, k + 3: [float("inf")] * 16, k + 4: [None] * 16, k + 5: [], k + 6: [1.0, 0.0], k + 7: [1.0, 0.1], k + 8: [1e-30] * 16, k + 9: [2e-30] * 16}
    return out


def check(got, want):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert got.keys() == want.keys()
    assert [i for i in want if got[i] != want[i]] == []


def test_against_brute_force(spark, vectors):
    check(G.near_duplicates(frame(spark, vectors)), brute(vectors))


def test_many_clusters_and_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(G, "PER_CLUSTER", 40)
    monkeypatch.setattr(G, "BLOCK", 24)
    check(G.near_duplicates(frame(spark, vectors)), brute(vectors))


def test_clusters_within_clusters(spark, vectors, monkeypatch):
    monkeypatch.setattr(G, "MOST_CLUSTERS", 2)
    monkeypatch.setattr(G, "PER_CLUSTER", 20)
    monkeypatch.setattr(G, "SPLIT", 60)
    check(G.near_duplicates(frame(spark, vectors)), brute(vectors))


def test_six_thousand_vectors(spark, tmp_path):
    """Groups of four among single vectors: the recall over all links, and that the audit reports about the same."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1500, 32))
    x = (np.repeat(centres, 4, 0) + rng.normal(size=(6000, 32)) * 0.2).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    got = G.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert true.sum() > 10_000 and (found <= true).all() and found.sum() / true.sum() >= 0.99
    assert got["audit_recall"].iloc[0] >= 0.97


def test_exact_where_recall_is_low(spark, vectors, monkeypatch):
    monkeypatch.setattr(G, "WIDEST", 1)
    monkeypatch.setattr(G, "RECALL", 1.1)
    monkeypatch.setattr(G, "LEAST_RECALL", 1.1)
    monkeypatch.setattr(G, "PER_CLUSTER", 10)
    monkeypatch.setattr(G, "BLOCK", 50)
    check(G.near_duplicates(frame(spark, vectors)), brute(vectors))


def test_no_links_and_several_vectors_of_an_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in G.near_duplicates(df).collect())
    # of 3 the vector (0, 1) takes part, beside both rows of 2
    assert got == [("1", 0, 1), ("2", 2, 2), ("2", 2, 2), ("3", 0, 3), ("3", 2, 2), ("None", 0, None)]
    alone = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.audit_recall for r in G.near_duplicates(alone).collect()} == {None}


def test_one_dense_group(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 40)
    rng = np.random.default_rng(2)
    v = {i: (np.ones(12) + rng.normal(size=12) * 0.1).tolist() for i in range(200)}
    check(G.near_duplicates(frame(spark, v)), brute({i: np.float32(x).tolist() for i, x in v.items()}))


def test_empty_and_repeated(spark):
    assert G.near_duplicates(frame(spark, {})).count() == 0
    twice = frame(spark, {1: [1.0, 0.0]}).unionAll(frame(spark, {1: [1.0, 0.0]}))
    assert [(r.n_links, r.component_id, r.kept) for r in G.near_duplicates(twice).collect()] == [(1, 1, True)] * 2
