import re
from collections import defaultdict

import pytest

from tessera.llm import curriculum as C


def water_fill(sizes):
    """Targets by plain rounds: share what is left by weight among sources under their caps."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in open_}
        capped |= {s: 3.0 * sizes[s] for s in over}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture
def rows(prose):
    out = [(k, prose(k % 37), "en", f"s{k % 7}") for k in range(400)] + [(1000 + k, prose(200), "en", "hot") for k in range(150)]
    return [*out, (2000, None, "en", "s1"), (2001, "", "en", "void"), (2002, "a\x0bb c\xa0d", "en", None), (None, "no id", "en", "s2"), (7, "tie", "en", "s3"), (7, "tie", "en", "s3")]


def test_targets_and_takes(spark, documents, rows):
    got = C.mix_sources(documents(rows)).select("doc_id", "source", "size", "source_size", "target", C.taken(C.F.col("passes")).alias("taken")).collect()
    assert len(got) == len(rows)
    sizes, takes = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = water_fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        takes[r.source] += r.taken
    for s in sizes:
        assert takes[s] == pytest.approx(want[s], abs=1)


def test_positions_invert_the_demand(spark, documents, rows):
    for r in C.mix_sources(documents(rows)).select("source", "size", "target", "source_size", "passes").collect():
        for p in r.passes:
            assert 0 <= p.position <= 1
    slopes = spark.range(1).select(*[C.invert_demand(C.F.lit(float(x)), C.F.lit(10.0), C.F.lit(s)).alias(f"t{k}_{x}") for k, s in enumerate((-0.5, 0.0, 0.5)) for x in (0, 3, 10)]).first()
    for k, s in enumerate((-0.5, 0.0, 0.5)):
        for x in (0, 3):
            t = slopes[f"t{k}_{x}"]
            assert 10 * ((1 - s) * t + s * t * t) == pytest.approx(x)
        assert slopes[f"t{k}_10"] is None  # all that is asked for is words 0 to 9


def test_schedule_makes_the_result(spark, documents, rows):
    """Ranks and takes against a plain loop over all passes in the order of their positions, for two schedules."""
    results = []
    for slope in (C.slope_of, lambda w: (2 - w) * C.F.lit(0.5)):
        sign = 1 if slope is C.slope_of else -1
        got = C.curriculum(documents(rows), slope).collect()
        placed = C.mix_sources(documents(rows), slope=slope).collect()
        passes = []
        for r in placed:
            s, goal = sign * (r.weight - 2) * 0.5, round(r.target)
            for epoch in range(3):
                first = r.x + epoch * r.source_size
                if r.size and first < goal:
                    share = first / goal
                    at = share if s == 0 else (((1 - s) ** 2 + 4 * s * share) ** 0.5 - (1 - s)) / (2 * s)
                    passes.append((at, -1 if r.doc_id is None else r.doc_id, epoch, r.source, r.x, min(r.size, goal - first)))
        want = defaultdict(list)
        for rank, (at, i, _, source, x, take) in enumerate(sorted(passes, key=lambda p: p[:3])):
            want[i, source, x].append((rank, at, take))
        expected = sorted((i, len(v), v[0][0], v[-1][0], sum(t for *_, t in v)) for (i, _, _), v in want.items())
        assert expected == sorted((-1 if r.doc_id is None else r.doc_id, r.n_passes, r.first_rank, r.last_rank, r.taken) for r in got if r.n_passes)
        assert len(got) == len(rows) and all(r.taken == 0 and r.first_rank is None for r in got if not r.n_passes)
        results.append({r.doc_id: r.first_rank for r in got if r.n_passes and r.doc_id != 7})
    assert results[0] != results[1]


def test_extreme_rows(spark, documents):
    """A very long text, equal rows, a null source beside one named like nothing, null ids."""
    data = [(1, "w " * 200_000, "en", "a"), (2, "x y", "en", None), (2, "x y", "en", None), (None, "z", "en", ""), (None, None, "en", "")]
    got = C.curriculum(documents(data)).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == pytest.approx(sum({(r.source_size): r.target for r in got}.values()), abs=3)
    assert max(r.size for r in got) == 200_000
    assert C.curriculum(documents([])).count() == 0


def test_training_order(spark, documents, rows):
    df = documents(rows)
    out = C.in_training_order(df, 4)
    assert out.columns == df.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.doc_id, r.source] += 1
    assert max(n for (i, _), n in copies.items() if i != 7) <= 3


def test_reruns_and_empty(spark, documents, rows):
    a, b = (sorted(str(r) for r in C.mix_sources(documents(rows).repartition(n)).collect()) for n in (1, 5))
    assert a == b
    assert C.mix_sources(documents([])).count() == 0
    assert C.mix_sources(documents([(1, None), (2, "")])).select("target").distinct().collect()[0][0] == 0
