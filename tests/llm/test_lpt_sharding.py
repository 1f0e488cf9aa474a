import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import lpt_sharding as L


@pytest.mark.parametrize("shards", [3, 16])
def test_law(spark, documents, prose, shards):
    rows = [(k, prose(k % 60)) for k in range(900)] + [(1000 + k, "a copy of one text") for k in range(100)] + [(2000, None), (2001, ""), (2002, None), (None, "no id"), (7, "tie"), (7, "tie"), (3000, "é" * 500)]
    got = L.shard_by_lpt(documents(rows), shards).collect()
    assert len(got) == len(rows)
    texts = Counter((i, t or "") for i, t in rows)
    sizes = {len(t.encode()) + 1 for _, t in texts}
    assert {r.size for r in got} == sizes and {r.text_crc32 for r in got} == {zlib.crc32(t.encode()) for _, t in texts}
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load[s] for s in range(shards)) <= 2000 + 100 * 19 * (shards > 10)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_lpt_equals_plain_greedy(shards):
    import random

    for seed in range(30):
        rng = random.Random(seed)
        classes = {rng.randint(1, 60): rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 12))}
        load, want = [0] * shards, {}
        for size in sorted(classes, reverse=True):
            given = want.setdefault(size, [0] * shards)
            for _ in range(classes[size]):
                at = load.index(min(load))
                given[at] += 1
                load[at] += size
        assert dict(L.lpt(list(classes.items()), shards)) == want


def test_every_group_is_scheduled(spark, documents, prose):
    """Loads by shard are those of a plain greedy over all groups, a long text and many of one size among them."""
    rows = [(k, f"{k:04d}") for k in range(1500)] + [(2000 + k, prose(k % 90)) for k in range(400)] + [(9000, "long " * 20_000)]
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t.encode()) + 1
    want = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        want[want.index(min(want))] += size
    got = Counter()
    for r in L.shard_by_lpt(documents(rows)).collect():
        got[r.shard] += r.size
    assert [got[s] for s in range(16)] == want


def test_a_group_larger_than_a_shard(spark, documents, prose):
    rows = [(k, "the same long text " * 30) for k in range(300)] + [(1000 + k, prose(20)) for k in range(500)]
    got = L.shard_by_lpt(documents(rows), 4).collect()
    big = {r.shard for r in got if r.doc_id < 300}
    assert len(big) == 1 and not {r.shard for r in got if r.doc_id >= 1000} & big


def test_reruns_and_empty(spark, documents, prose):
    rows = [(k, prose(10)) for k in range(50)]
    a, b = (sorted(map(tuple, L.shard_by_lpt(documents(rows).repartition(n)).collect())) for n in (1, 7))
    assert a == b
    assert L.shard_by_lpt(documents([])).count() == 0
