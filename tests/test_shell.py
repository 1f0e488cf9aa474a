from tessera.cli import Shell, complete, hint


def test_shell(spark):
    s = Shell(spark)
    assert s.feed("CREATE NODE TABLE P(id INT64,") == ""
    assert "done" in s.feed("PRIMARY KEY(id));")
    s.feed("CREATE (p:P {id: 1});")
    assert "| 1 " in s.feed("MATCH (p:P) RETURN p.id;")
    assert s.feed("MATCH (p:Q) RETURN p;").startswith("error")
    assert "P" in s.feed(".tables") and "id bigint" in s.feed(".schema P") and s.feed(".database") == "in memory"
    assert "unknown" in s.feed(".nope") and ".help" in s.feed(".help") and s.feed(".quit") is None


def test_complete():
    assert complete("mat") == ["MATCH"] and ".tables" in complete(".t") and complete("") == []


def test_hint():
    assert hint("MATCH (n) RETU") == "RN" and hint(".tab") == "les" and hint("MATCH ") == hint("") == hint("W") == hint("nope") == ""
