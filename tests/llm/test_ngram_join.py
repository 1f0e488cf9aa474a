import re
from collections import defaultdict

import pytest

from tessera.llm import ngram_join as J


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([t.strip()]) if t and t.strip() else frozenset()
    return out


def brute(rows, threshold=0.8):
    sets, near = shingle_sets(rows), defaultdict(list)
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                near[i].append(j)
                near[j].append(i)
    least = {}
    for i in ids:
        if i not in least:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in least:
                    least[k] = i
                    stack += near[k]
    return {i: (least[i], len(near[i])) for i in ids}


@pytest.fixture
def corpus(prose):
    rows, k = [], 0
    for group in range(30):
        words = prose(60 + group).split()
        for copy in range(group % 5 + 1):
            w = list(words)
            for e in range(copy):
                w[(e * 17 + 3) % len(w)] = f"edit{copy}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + i, prose(40)) for i in range(40)]
    k += 40
    rows += [(k, None), (k + 1, ""), (k + 2, "  "), (k + 3, "one two"), (k + 4, "One, two!"), (k + 5, "!!!"), (k + 6, "!!!"), (k + 7, prose(20_000))]
    rows += [(k + 8 + i, rows[3][1].upper()) for i in range(15)]
    return rows


def check(df, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.ngram_join(df).collect()}
    want = brute(rows)
    assert [i for i in want if got[i] != want[i]] == []


def test_against_brute_force(spark, documents, corpus):
    check(documents(corpus).repartition(3), corpus)


def test_one_large_group_in_blocks(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_BLOCK", 12)
    monkeypatch.setattr(J, "GROUP_BLOCK", 10)
    words = prose(150).split()
    rows = []
    for k in range(70):
        w = list(words)
        w[k * 2] = f"own{k}"
        w[(k * 2 + 50) % 150] = f"mine{k}"
        rows.append((k, " ".join(w)))
    check(documents(rows), rows)


def test_pruning_bounds():
    least = J.least_matches(0.8, 1e-6)
    assert least[0] == 0 and all(0 <= m <= n for n, m in enumerate(least)) and least[96] > 40
    from math import comb

    for n in (16, 48, 96):  # the posterior of a dropped pair is under the tolerance
        m = least[n] - 1
        assert sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1)) < 1e-6


def test_keep_one(spark, documents, corpus):
    rows = [*corpus, (5000, "kept words of no other text"), (5000, "kept words of no other text"), (None, "without an id")]
    df = documents(rows)
    kept = J.keep_one(df)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    want = brute([r for r in rows if r[0] is not None])
    assert kept.columns == df.columns
    assert ids == sorted([str(i) for i, (c, _) in want.items() if c == i] + ["None"])


def test_empty_and_threshold(spark, documents):
    assert J.ngram_join(documents([])).count() == 0
    with pytest.raises(ValueError):
        J.ngram_join(documents([]), 0.5)
