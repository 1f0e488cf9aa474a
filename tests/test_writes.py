import threading

import pytest

from tessera.errors import BindError, ConstraintError, TransactionError
from tessera.session import GraphSession

P = "CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id));"
READ = "MATCH (p:P) RETURN p.id AS id, p.name AS name"


def test_create_set_delete_merge(graph, rows):
    graph.execute_script(P + "CREATE (a:P {id: 1, name: 'a'}), (b:P {id: 2})")
    assert rows(graph.cypher("MATCH (p:P) SET p.name = concat('n', p.id) RETURN p.name AS n")) == [("n1",), ("n2",)]
    graph.cypher("MERGE (p:P {id: 2}) ON MATCH SET p.name = 'met' ON CREATE SET p.name = 'new'")
    graph.cypher("MERGE (p:P {id: 3}) ON MATCH SET p.name = 'met' ON CREATE SET p.name = 'new'")
    graph.cypher("MATCH (p:P {id: 1}) DELETE p")
    assert rows(graph.cypher(READ)) == [(2, "met"), (3, "new")]


def test_create_a_path_and_per_row(graph, rows):
    graph.execute_script(P + "CREATE REL TABLE K(FROM P TO P); CREATE (a:P {id: 1})-[:K]->(b:P {id: 2})")
    graph.cypher("MATCH (p:P) CREATE (q:P {id: p.id + 10, name: 'copy'})-[:K]->(p)")
    assert rows(graph.cypher("MATCH (a:P)-[:K]->(b:P) RETURN a.id AS a, b.id AS b")) == [(1, 2), (11, 1), (12, 2)]


def test_keys(graph):
    graph.execute_script(P + "CREATE (a:P {id: 1})")
    for text in ("CREATE (a:P {id: 1})", "CREATE (a:P {id: 5}), (b:P {id: 5})", "CREATE (a:P {name: 'x'})"):
        with pytest.raises(ConstraintError):
            graph.cypher(text)
    assert graph.cypher(READ).count() == 1  # a failed statement leaves nothing
    graph.cypher("CREATE (a:P {id: 2})")
    with pytest.raises(ConstraintError):
        graph.cypher("MATCH (p:P {id: 2}) SET p.id = 1")


def test_detach(graph, rows):
    graph.execute_script(P + "CREATE REL TABLE K(FROM P TO P); CREATE (a:P {id: 1})-[:K]->(b:P {id: 2})")
    with pytest.raises(ConstraintError):
        graph.cypher("MATCH (p:P {id: 2}) DELETE p")
    graph.cypher("MATCH (p:P {id: 2}) DETACH DELETE p")
    assert rows(graph.cypher("CALL degree_centrality('K')")) == [(0, 0, 0)]


def test_relationship_set_and_delete(graph, rows):
    graph.execute_script(P + "CREATE REL TABLE K(FROM P TO P, w DOUBLE); CREATE (a:P {id: 1})-[:K {w: 1}]->(b:P {id: 2})")
    graph.cypher("MATCH (a:P)-[k:K]->(b:P) SET k.w = k.w * 4")
    assert rows(graph.cypher("MATCH (a:P)-[k:K]->(b:P) RETURN k.w AS w")) == [(4.0,)]
    graph.cypher("MATCH (a:P)-[k:K]->(b:P) DELETE k")
    assert rows(graph.cypher("MATCH (a:P)-[k:K]->(b:P) RETURN k.w AS w")) == []


def test_serial(graph, rows):
    graph.execute_script("CREATE NODE TABLE S(id SERIAL, v STRING, PRIMARY KEY(id)); CREATE (a:S {v: 'a'}); CREATE (a:S {id: 100, v: 'x'}); CREATE (a:S {v: 'b'})")
    assert rows(graph.cypher("MATCH (s:S) RETURN s.id AS id, s.v AS v")) == [(0, "a"), (1, "b"), (100, "x")]


def test_ddl(graph):
    graph.execute_script(P + "CREATE REL TABLE K(FROM P TO P)")
    for text in (P, "CREATE REL TABLE R(FROM P TO Q)", "DROP TABLE P", "DROP TABLE X", "ALTER TABLE P ADD COLUMN name INT64", "ALTER TABLE P DROP COLUMN id", "CREATE NODE TABLE Z(a INT64, PRIMARY KEY(b))"):
        with pytest.raises(BindError):
            graph.cypher(text.rstrip(";"))
    graph.execute_script("ALTER TABLE P RENAME TO Q; ALTER TABLE Q ADD z DOUBLE; DROP TABLE K; DROP TABLE Q")
    assert graph.node_table_names() == [] and graph.rel_table_names() == []


def test_snapshots(graph, rows):
    graph.execute_script(P + "CREATE (a:P {id: 1, name: 'original'})")
    before = graph.cypher(READ)
    graph.cypher("MATCH (p:P) SET p.name = 'new'")
    assert rows(before) == [(1, "original")] and rows(graph.cypher(READ)) == [(1, "new")]


def test_one_writer(graph):
    graph.cypher(P.rstrip(";"))
    graph._writing.acquire()
    seen = []

    def write():
        try:
            graph.cypher("CREATE (a:P {id: 1})")
        except TransactionError as e:
            seen.append(e)

    t = threading.Thread(target=write)
    t.start()
    t.join()
    graph._writing.release()
    assert seen


def test_csv(graph, rows, tmp_path):
    (tmp_path / "in.csv").write_text('id,name\n1,"a, ""b"""\n2,NULL\n\n3\n4,\\N\n')
    graph.execute_script(P + f"COPY P FROM '{tmp_path}/in.csv'")
    assert rows(graph.cypher(READ)) == [(1, 'a, "b"'), (2, None), (3, None), (4, None)]
    graph.cypher(f"COPY (MATCH (p:P) RETURN p.id AS id, p.name AS name ORDER BY id) TO '{tmp_path}/out.csv' (HEADER, DELIMITER '|')")
    assert (tmp_path / "out.csv").read_text().splitlines()[:3] == ["id|name", '1|"a, ""b"""', "2|"]
    with pytest.raises(ConstraintError):
        graph.cypher(f"COPY P FROM '{tmp_path}/in.csv'")
    graph.execute_script("CREATE NODE TABLE B(id INT64, ok BOOL, PRIMARY KEY(id))")
    (tmp_path / "b.tsv").write_text("1\tyes\n2\tF\n")
    graph.cypher(f"COPY B FROM '{tmp_path}/b.tsv' (HEADER=false, DELIMITER '\t')")
    assert rows(graph.cypher("MATCH (b:B) RETURN b.id AS id, b.ok AS ok")) == [(1, True), (2, False)]


def test_store(spark, rows, tmp_path):
    root = f"{tmp_path}/db"
    g = GraphSession(spark, root)
    g.execute_script(P + "CREATE REL TABLE K(FROM P TO P); CREATE (a:P {id: 1, name: 'x'})-[:K]->(b:P {id: 2})")
    g.cypher("MATCH (p:P {id: 2}) SET p.name = 'y'")
    again = GraphSession(spark, root)
    assert rows(again.cypher(READ)) == [(1, "x"), (2, "y")]
    again.checkpoint()
    assert rows(again.cypher("MATCH (a:P)-[:K]->(b:P) RETURN b.name AS n")) == [("y",)]
    reader = GraphSession(spark, root, read_only=True)
    with pytest.raises(TransactionError):
        reader.cypher("CREATE (a:P {id: 3})")


def test_two_writers_of_a_folder(spark, rows, tmp_path):
    root = f"{tmp_path}/db"
    GraphSession(spark, root).execute_script(P + "CREATE (a:P {id: 1})")
    x, y = GraphSession(spark, root), GraphSession(spark, root)
    old = y.cypher(READ)
    x.cypher("CREATE (a:P {id: 2})")
    y.cypher("CREATE (a:P {id: 3})")  # takes over x's version first
    assert rows(GraphSession(spark, root).cypher(READ)) == [(1, None), (2, None), (3, None)]
    x.checkpoint()
    assert rows(old) == [(1, None)]  # the files of a late version stay for its readers
    x.refresh()
    after, y.store.version = x.catalog, y.store.version - 1
    with pytest.raises(TransactionError):
        y.store.publish(after, after)
    x.store.fs.create(x.store._path(f"claims/{x.store.version + 1}"), False).close()  # someone else is at it
    with pytest.raises(TransactionError):
        x.cypher("CREATE (a:P {id: 4})")
    assert rows(GraphSession(spark, root).cypher(READ)) == [(1, None), (2, None), (3, None)]
    x.store.fs.delete(x.store._path(f"claims/{x.store.version + 1}"), False)
    x.checkpoint(0)
    assert rows(GraphSession(spark, root).cypher(READ)) == [(1, None), (2, None), (3, None)]


def test_many_appends_leave_few_parts(spark, graph, rows, tmp_path):
    stored = GraphSession(spark, f"{tmp_path}/db")
    for g, n in ((graph, 50), (stored, 12)):
        g.cypher(P.rstrip(";"))
        for k in range(n):
            g.cypher(f"CREATE (a:P {{id: {k}}})")
        assert g.catalog.node("P").rows.rdd.getNumPartitions() <= 12
        assert rows(g.cypher("MATCH (p:P) RETURN count(*) AS n, sum(p.id) AS s")) == [(n, n * (n - 1) // 2)]
    assert len(GraphSession(spark, f"{tmp_path}/db").catalog.node("P").parts.each) <= 5


def test_stream(spark, rows, tmp_path):
    """Keys that aren't offsets, ends that don't exist, and a restart over the same checkpoint and folder."""
    from tessera.streaming import append_rels

    root = f"{tmp_path}/db"
    graph = GraphSession(spark, root)
    graph.execute_script("CREATE NODE TABLE P(id STRING, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w DOUBLE); CREATE (a:P {id: 'x'}), (b:P {id: 'y'}), (c:P {id: 'z'})")

    def run(session, checkpoint):
        stream = spark.readStream.schema("s string, t string, w double").parquet(f"{tmp_path}/in")
        query = append_rels(session, "K", stream, "s", "t", f"{tmp_path}/{checkpoint}")
        query.processAllAvailable()
        query.stop()

    read = "MATCH (a:P)-[k:K]->(b:P) RETURN a.id AS a, k.w AS w, b.id AS b"
    spark.createDataFrame([("z", "x", 1.0), ("x", "none", 2.0)], "s string, t string, w double").write.parquet(f"{tmp_path}/in")
    run(graph, "ck")
    assert rows(graph.cypher(read)) == [("z", 1.0, "x")]
    again = GraphSession(spark, root)
    applied = dict(again.catalog.applied)
    # the same batch once more, as after a crash between the write and the checkpoint
    import shutil

    shutil.rmtree(f"{tmp_path}/ck")
    run(again, "ck")
    assert rows(again.cypher(read)) == [("z", 1.0, "x")] and again.catalog.applied == applied
    spark.createDataFrame([("y", "z", 3.0)], "s string, t string, w double").write.mode("append").parquet(f"{tmp_path}/in")
    run(again, "ck")
    assert rows(GraphSession(spark, root).cypher(read)) == [("y", 3.0, "z"), ("z", 1.0, "x")]
