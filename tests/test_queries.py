import pytest

from tessera.errors import BindError, GraphError

PEOPLE = "CREATE NODE TABLE P(id INT64, name STRING, age INT64, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, since INT64);"


@pytest.fixture
def people(graph):
    graph.execute_script(PEOPLE)
    graph.cypher("CREATE (a:P {id: 1, name: 'Aino', age: 41}), (b:P {id: 2, name: 'Bram', age: 22}), (c:P {id: 3, name: 'Coro', age: 57}), (d:P {id: 4, name: 'Dael'})")
    graph.cypher("MATCH (a:P), (b:P) WHERE b.id = a.id + 1 CREATE (a)-[:K {since: a.id * 100}]->(b)")
    return graph


def test_order_limit_skip(people, rows):
    got = [r[0] for r in people.cypher("MATCH (p:P) RETURN p.name AS n ORDER BY p.age DESC SKIP 1 LIMIT 2").collect()]
    assert got == ["Coro", "Aino"]  # NULL comes first downwards
    assert [r[0] for r in people.cypher("MATCH (p:P) RETURN p.name AS n ORDER BY p.age").collect()] == ["Bram", "Aino", "Coro", "Dael"]


def test_aggregates(people, rows):
    assert rows(people.cypher("MATCH (p:P) RETURN count(*) AS n, count(p.age) AS a, sum(p.age) AS s, avg(p.age) AS m, min(p.name) AS lo, max(p.age) AS hi")) == [(4, 3, 120, 40.0, "Aino", 57)]
    assert rows(people.cypher("MATCH (p:P) WHERE p.id > 9 RETURN count(*) AS n, sum(p.age) AS s")) == [(0, None)]
    assert rows(people.cypher("MATCH (p:P) WHERE p.id > 9 RETURN p.name AS g, count(*) AS n")) == []
    assert rows(people.cypher("MATCH (p:P) RETURN p.id % 2 AS odd, count(*) + 1 AS n ORDER BY odd")) == [(0, 3), (1, 3)]


def test_expand_and_properties(people, rows):
    assert rows(people.cypher("MATCH (a:P)-[k:K]->(b:P) WHERE k.since >= 200 RETURN a.name, k.since, b.name")) == [("Bram", 200, "Coro"), ("Coro", 300, "Dael")]
    assert rows(people.cypher("MATCH (a:P)<-[:K]-(b:P) RETURN a.id AS a, b.id AS b")) == [(2, 1), (3, 2), (4, 3)]
    assert rows(people.cypher("MATCH (a:P {id: 2})-[:K]-(b:P) RETURN b.id AS b")) == [(1,), (3,)]
    assert rows(people.cypher("MATCH (a:P)-[:K]->(b:P)-[:K]->(c:P) RETURN a.id AS a, c.id AS c")) == [(1, 3), (2, 4)]
    assert rows(people.cypher("MATCH (a:P)-[:K]->(b:P), (b)-[:K]->(c:P) RETURN a.id AS a, c.id AS c")) == [(1, 3), (2, 4)]


def test_self_loop_and_parallel_edges(people, rows):
    people.cypher("MATCH (a:P {id: 1}) CREATE (a)-[:K]->(a)")
    people.cypher("MATCH (a:P {id: 1}), (b:P {id: 2}) CREATE (a)-[:K]->(b)")
    assert rows(people.cypher("MATCH (a:P {id: 1})-[:K]-(b:P) RETURN b.id AS b")) == [(1,), (1,), (2,), (2,)]


def test_optional(people, rows):
    assert rows(people.cypher("MATCH (a:P) OPTIONAL MATCH (a)-[:K]->(b:P) RETURN a.id AS a, b.name AS b")) == [(1, "Bram"), (2, "Coro"), (3, "Dael"), (4, None)]
    chained = "MATCH (a:P) OPTIONAL MATCH (a)-[:K]->(b:P) WHERE b.id > 2 OPTIONAL MATCH (b)-[:K]->(c:P) RETURN a.id AS a, b.id AS b, c.id AS c"
    assert rows(people.cypher(chained)) == [(1, None, None), (2, 3, 4), (3, 4, None), (4, None, None)]


def test_exists(people, rows):
    assert rows(people.cypher("MATCH (a:P) WHERE EXISTS { MATCH (a)-[:K]->(b:P) WHERE b.name = 'Bram' } RETURN a.id AS a")) == [(1,)]
    assert rows(people.cypher("MATCH (a:P) WHERE NOT EXISTS { MATCH (a)-[:K]->(b:P) } RETURN a.id AS a")) == [(4,)]
    assert rows(people.cypher("MATCH (a:P) WHERE a.id = 4 OR EXISTS { MATCH (a)-[:K]->(b:P) WHERE b.age > a.age } RETURN a.id AS a")) == [(2,), (4,)]
    assert rows(people.cypher("MATCH (a:P) RETURN a.id AS a, EXISTS { MATCH (a)-[:K]->(b:P) } AS e")) == [(1, True), (2, True), (3, True), (4, False)]


def test_subquery_union_unwind(people, rows):
    assert rows(people.cypher("MATCH (a:P) CALL { MATCH (b:P) RETURN max(b.age) AS top } WITH a, top WHERE a.age = top RETURN a.name AS n")) == [("Coro",)]
    assert rows(people.cypher("RETURN 1 AS x UNION RETURN 1 AS y UNION RETURN 2 AS z")) == [(1,), (2,)]
    assert len(rows(people.cypher("RETURN 1 AS x UNION ALL RETURN 1 AS y"))) == 2
    assert rows(people.cypher("UNWIND [1, 2] AS x UNWIND [10, 20] AS y RETURN x + y AS s")) == [(11,), (12,), (21,), (22,)]
    assert rows(people.cypher("UNWIND NULL AS x RETURN x")) == []


def test_with_and_distinct(people, rows):
    assert rows(people.cypher("MATCH (a:P) WITH a AS b, a.age / 10 AS d WHERE d >= 3 RETURN b.name AS n, d")) == [("Aino", 4), ("Coro", 5)]
    assert rows(people.cypher("MATCH (a:P)-[:K]-(b:P) RETURN DISTINCT a.id % 2 AS m")) == [(0,), (1,)]
    assert rows(people.cypher("MATCH (a:P) RETURN count(DISTINCT a.id % 2) AS n")) == [(2,)]


def test_paths(people, rows):
    people.cypher("MATCH (a:P {id: 1}), (d:P {id: 4}) CREATE (a)-[:K]->(d)")
    assert rows(people.cypher("MATCH (a:P)-[:K*1..3]->(b:P) WHERE a.id = 1 RETURN b.id AS b")) == [(2,), (3,), (4,)]
    assert rows(people.cypher("MATCH (a:P)-[:K*2..2]->(b:P) WHERE a.id = 1 RETURN b.id AS b")) == [(3,)]
    short = "MATCH (a:P {id: 1}), (b:P), p = shortestPath((a)-[:K*..5]->(b)) RETURN b.id AS b, length(p) AS l"
    assert rows(people.cypher(short)) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert rows(people.cypher("MATCH (a:P {id: 4}), (b:P {id: 1}), p = shortestPath((a)-[:K*]->(b)) RETURN length(p) AS l")) == []


def test_all_shortest_paths(graph, rows):
    graph.execute_script("CREATE NODE TABLE N(id INT64, PRIMARY KEY(id)); CREATE REL TABLE E(FROM N TO N); CREATE (a:N {id: 1}), (b:N {id: 2}), (c:N {id: 3}), (d:N {id: 4})")
    for a, b in [(1, 2), (1, 3), (2, 4), (3, 4)]:
        graph.cypher(f"MATCH (a:N {{id: {a}}}), (b:N {{id: {b}}}) CREATE (a)-[:E]->(b)")
    q = "MATCH (a:N {id: 1}), (b:N {id: 4}), p = allShortestPaths((a)-[:E*]->(b)) RETURN length(p) AS l, list_extract(nodes(p), 2) AS via"
    assert rows(graph.cypher(q)) == [(2, 1), (2, 2)]  # offsets of the nodes 2 and 3


@pytest.mark.parametrize(
    "text, value",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7 / 2.0", 3.5), ("1 = 1.0", True), ("'a' < 1", False), ("NULL = 1", None), ("NULL IN [1]", False), ("NULL NOT IN [1]", True),
        ("2 IN [1, NULL]", False), ("TRUE OR NULL", True), ("FALSE AND NULL", False), ("NOT NULL", None), ("'abc' =~ 'b'", True), ("'a' + 'b'", "ab"), ("1 + 'a'", None),
        ("length('é')", 2), ("substring('hello', 1, 3)", "ell"), ("substring('hello', -2)", "hello"), ("lpad('ab', 5, 'xy')", "xxxab"), ("lpad('abc', 2)", "ab"), ("trim('\t a ')", "a"),
        ("concat('a', NULL, 1)", "a1"), ("to_string(3.0)", "3"), ("to_string(NULL)", "NULL"), ("to_string([1, NULL])", "[1, NULL]"), ("coalesce(NULL, 2)", 2), ("ceil(1.2)", 2.0), ("sign(-3.5)", -1),
        ("round(-2.5)", -3.0), ("log(0)", float("-inf")), ("toInteger('12')", 12), ("toInteger(3.9)", 3), ("CAST(TRUE AS DOUBLE)", 1.0), ("CAST('yes' AS BOOL)", True),
        ("list_extract([1, 2, 3], -1)", 3), ("list_extract([1], 0)", None), ("list_contains([NULL], NULL)", True), ("[x IN [1, 2, 3] WHERE x > 1 | x * 2]", [4, 6]), ("[x IN NULL | x]", None),
        ("range(3, 1)", [3, 2, 1]), ("range(1, 5, -1)", []), ("size([1, 2])", 2), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN NULL THEN 1 END", None), ("repeat('ab', 2)", "abab"),
        ("timestamp(datetime('1970-01-02T00:00:01'))", 86401), ("reverse('abc')", "cba"), ("left('abc', 2)", "ab"), ("right('abc', 2)", "bc"), ("list_sort([2, NULL, 1])", [None, 1, 2]), ("abs(-3)", 3),
    ],
)
def test_expressions(graph, text, value):
    assert graph.cypher(f"RETURN {text} AS x").collect()[0][0] == value


@pytest.mark.parametrize("text", ["RETURN x", "MATCH (p:Q) RETURN p", "MATCH (p:P) RETURN p.nope", "RETURN foo(1)", "MATCH (a:P)-[:Z]->(b) RETURN a", "RETURN lower(1)", "MATCH (p:P) SET p.age = 'x'", "RETURN 1 AS a UNION RETURN 1 AS a, 2 AS b", "CALL wcc('K') YIELD nope", "CALL nope()"])
def test_bind_errors(graph, text):
    graph.execute_script(PEOPLE)
    with pytest.raises(BindError):
        graph.cypher(text)


def test_division_by_zero(graph):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        graph.cypher("RETURN 1 / 0 AS x").collect()


def test_parameters_and_prepared(people, rows):
    q = people.prepare("MATCH (p:P) WHERE p.id IN $ids RETURN p.name AS n")
    assert rows(q.execute({"ids": [1, 2]})) == [("Aino",), ("Bram",)]
    assert rows(q.execute({"ids": [3]})) == [("Coro",)]
    assert rows(q.execute()) == []


def test_unlabelled_and_untyped(people, rows):
    people.execute_script("CREATE NODE TABLE C(name STRING, PRIMARY KEY(name)); CREATE REL TABLE L(FROM P TO C); CREATE (c:C {name: 'Rome'})")
    people.cypher("MATCH (p:P {id: 1}), (c:C) CREATE (p)-[:L]->(c)")
    assert rows(people.cypher("MATCH (n) RETURN count(*) AS n")) == [(5,)]
    assert rows(people.cypher("MATCH (p:P {id: 1})-[]->(x) RETURN x.name AS n")) == [("Bram",), ("Rome",)]
    assert rows(people.cypher("MATCH (c:C)-[:K]->(p:P) RETURN p.id AS p")) == []
    with pytest.raises(GraphError):
        people.cypher("MATCH (p:P)-[:L*1..2]->(c:C) RETURN c")
