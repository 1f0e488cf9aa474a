import pytest

from tessera.errors import BindError


@pytest.fixture
def edges(graph, spark):
    def make(pairs, n=None, weights=None):
        ids = sorted({x for p in pairs for x in p} | set(range(n or 0)))
        graph.register_nodes("N", spark.createDataFrame([(i,) for i in ids], "id long"), "id")
        rows = [(a, b, float(w)) for (a, b), w in zip(pairs, weights or [1] * len(pairs))]
        graph.register_rels("E", spark.createDataFrame(rows, "a long, b long, w double"), "N", "N", "a", "b")
        return graph

    return make


def test_degree(edges, rows):
    assert rows(edges([(0, 1), (0, 1), (2, 2)], 4).call("degree_centrality", "E")) == [(0, 2, 0), (1, 0, 2), (2, 1, 1), (3, 0, 0)]


def test_wcc(edges, rows):
    assert rows(edges([(0, 1), (2, 1), (5, 4), (4, 3)], 7).call("wcc", "E")) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 6)]


def test_wcc_long_chain(edges, rows):
    assert {r[1] for r in edges([(i + 1, i) for i in range(40)]).call("wcc", "E").collect()} == {0}


def test_dijkstra(edges, rows):
    g = edges([(10, 11), (11, 14), (10, 12), (12, 13), (13, 14), (10, 14)], weights=[2.5, 4, 1, 1.5, 3, 9])
    assert rows(g.call("dijkstra", 10, 14, "E", "w")) == [([10, 12, 13, 14], 5.5)]
    assert rows(g.call("dijkstra", 12, 12, "E", "w")) == [([12], 0.0)]
    assert rows(g.call("dijkstra", 14, 10, "E", "w")) == []
    assert rows(g.call("dijkstra", 10, 14, "E", "none")) == [([10, 14], 1.0)]
    with pytest.raises(BindError):
        g.call("dijkstra", 10, 99, "E", "w")


def test_pagerank(edges):
    score = {r.node_id: r.score for r in edges([(0, 1), (1, 2), (2, 0)]).call("pagerank", "E").collect()}
    assert sum(score.values()) == pytest.approx(1) and len(set(round(s, 9) for s in score.values())) == 1


def test_pagerank_chain(edges):
    score = {r.node_id: r.score for r in edges([(0, 1), (1, 2)], 4).call("pagerank", "E").collect()}
    assert sum(score.values()) == pytest.approx(1) and score[2] > score[1] > score[0] == pytest.approx(score[3])


def test_label_propagation(edges):
    """Against a plain loop over all vertices in the order of their ids."""
    import random
    from collections import Counter

    rng = random.Random(12)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in range(45)}
    label = {v: v for v in near}
    for _ in range(100):
        before = dict(label)
        for v in sorted(near):
            if near[v]:
                seen = Counter(label[u] for u in near[v])
                label[v] = min(seen, key=lambda x: (-seen[x], x))
        if label == before:
            break
    assert {r.node_id: r.community for r in edges(pairs, 45).call("label_propagation", "E").collect()} == label


def test_triangles(edges, rows):
    k4 = [(a, b) for a in range(4) for b in range(4) if a != b]
    assert rows(edges([*k4, (0, 0), (4, 0)]).call("triangle_count", "E")) == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 0)]


def test_betweenness(edges, rows):
    assert rows(edges([(0, 1), (1, 2), (2, 3)], 5).call("betweenness", "E")) == [(0, 0.0), (1, 2.0), (2, 2.0), (3, 0.0), (4, 0.0)]


def test_betweenness_star(edges, rows):
    assert rows(edges([(0, 1), (0, 2), (0, 3)]).call("betweenness", "E"))[0] == (0, 3.0)


def test_unknown_table(graph):
    with pytest.raises(BindError):
        graph.call("wcc", "nope")


def test_two_tables(graph, spark, rows):
    graph.register_nodes("A", spark.createDataFrame([(0,), (1,)], "id long"), "id")
    graph.register_nodes("B", spark.createDataFrame([("x",)], "name string"), "name")
    graph.register_rels("R", spark.createDataFrame([(0, "x")], "a long, b string"), "A", "B", "a", "b")
    assert rows(graph.call("degree_centrality", "R")) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
    assert len(rows(graph.call("wcc", "R"))) == 3
    assert {r[0] for r in graph.call("pagerank", "R").collect()} == {"0", "1", "x"}
