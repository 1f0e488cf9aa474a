import random

from tessera.llm.common import Scratch
from tessera.llm.components import components


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    up = {x: x for pair in links for x in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in up if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "e").count() == 0


def test_clear_scratch(spark):
    from tessera.llm.common import clear_scratch, filesystem

    s = Scratch(spark, "t")
    assert s.save("x", spark.range(3)).count() == 3
    fs, folder = filesystem(s.root)
    clear_scratch(spark)
    assert fs.get_file_info(folder).type.name == "NotFound"


def test_the_session_stays_as_it_was(spark):
    from tessera.llm import common as C

    before = {k: spark.conf.get(k) for k in C.BATCHES}
    seen = []
    df = C.settled(spark, "mine", lambda: C.Scratch(spark, "inner").save("x", spark.range(3)).mapInPandas(lambda bs: (b for b in bs), "id long"))
    with C.small_batches(spark):
        seen = [spark.conf.get(k) for k in C.BATCHES]
    assert df.count() == 3 and {k: spark.conf.get(k) for k in C.BATCHES} == before and seen == ["1000", "512"]


def test_hubs_are_joined_by_broadcast(spark, tmp_path, monkeypatch):
    """With few hubs and many, the components are those of a union-find."""
    import random

    from tessera.llm import components as K
    from tessera.llm.common import Scratch

    rng = random.Random(6)
    links = [(0, k) for k in range(1, 200)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(5000, 4000), (4000, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    for hubs in (1, 10_000):
        monkeypatch.setattr(K, "HUBS", hubs)
        got = {r.node: r.component for r in K.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "hubs"), "h").collect()}
        assert all(got[x] == find(x) for x in got) and {x for a, b in links if a != b for x in (a, b)} == set(got)
