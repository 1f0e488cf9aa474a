import hashlib
import random

import numpy as np
import pytest

from tessera.llm import induced_sort as I
from tessera.llm import suffix_dedup as S


def brute(rows):
    """n_bytes, n_removed, n_spans, sha256 of what is left, by a set of all strings."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - S.LENGTH + 1):
            s = b[p : p + S.LENGTH]
            if s in seen:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(s)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def check(df, rows):
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df).collect()}
    want = brute(rows)
    assert [i for i in want if got[i] != want[i]] == []


@pytest.fixture
def corpus(prose):
    passage, base = prose(60), prose(200)
    rows = [(k, f"{prose(20)} {passage} {prose(20)}") for k in range(40)]  # a passage in every document
    rows += [(100 + k, base) for k in range(20)]  # exact copies
    words = base.split()
    for k in range(20):  # near copies
        w = list(words)
        w[k * 9] = "changed"
        rows.append((200 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "short"), (303, "a" * 5000), (304, "ab" * 1000), (305, "é" * 300), (306, "x" * 99), (307, "x" * 100), (308, "x" * 100), (309, "same line\n" * 400)]
    rows += [(400, prose(30_000)), (401, f"{passage} {passage}")]
    return rows


def test_against_brute_force(spark, documents, corpus):
    check(documents(corpus).repartition(5), corpus)


def test_small_shards_and_spooled_queues(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(S, "QUEUE_TUPLES", 500)
    monkeypatch.setattr(S, "FLUSH_RUNS", 50)
    check(documents(corpus).repartition(3), corpus)


def test_long_text_in_segments(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 700)
    part = prose(300)
    rows = [(1, f"{prose(500)} {part} {prose(100)}"), (2, f"{part} {prose(400)} {part}")]
    check(documents(rows), rows)


def test_ids(spark, documents, prose):
    text = prose(50)
    got = S.remove_repeats(documents([(None, text), (3, text), (3, text), (5, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in got) == [("3", False), ("3", False), ("5", True), ("None", False)]
    assert S.remove_repeats(documents([])).count() == 0


def test_repeated_rows_in_one_task(spark, documents, prose):
    text, other = prose(50), prose(50)
    rows = [(3, text), (3, text), (5, f"{other} {other}"), (5, f"{other} {other}"), (7, text)]
    got = S.remove_repeats(documents(rows).coalesce(1)).collect()
    want = brute([rows[0], rows[2], rows[4]])
    assert sorted(tuple(r) for r in got) == sorted((i, *want[i]) for i, _ in rows)


def test_bytes_decide_when_all_hashes_collide(tmp_path, prose, monkeypatch):
    """Every piece and every context gets one hash; the stages run here, as Python workers would not see the patch."""
    import pandas as pd

    monkeypatch.setattr(S, "mix", lambda x: x * np.uint64(0))
    part = prose(25)
    rows = [(1, f"{prose(10)} {part}"), (2, f"{part} {prose(12)}"), (3, prose(30)), (4, prose(30)), (5, part)]
    found = pd.concat([pd.concat(S.find_runs(3)(iter([pd.DataFrame([r], columns=["doc_id", "text"])]))) for r in rows])
    met = [S.meet_runs(g) for _, g in found[found["entries"].notna()].groupby("bucket")]
    asked = pd.concat([found[found["asked"].notna()][["doc_id", "asked"]], *[m[["doc_id", "asked"]] for m in met]])
    lists = asked.groupby("doc_id")["asked"].apply(list)
    cut = pd.concat(S.cut_contexts(2, np.zeros(0, np.int64), 1)(iter([pd.DataFrame([(i, t, lists[i]) for i, t in rows if i in lists], columns=["doc_id", "text", "asked"])])))
    gone = [S.sort_shard(f"file://{tmp_path}", 1000)(g) for _, g in cut.groupby("shard")]
    gone = pd.concat([found[found["gone"].notna()][["doc_id", "gone"]], *gone]).groupby("doc_id")["gone"].apply(list)
    want = brute(rows)
    for i, text in rows:
        mask = S.removed_mask(len(text.encode()), gone.get(i))
        assert (int(mask.sum()), hashlib.sha256(bytes(c for c, m in zip(text.encode(), mask) if not m)).hexdigest()) == (want[i][1], want[i][3])
    assert want[2][1] > 100 and want[5][1] > 100


def test_overfull_shards(spark, documents, corpus, monkeypatch):
    """Shards far too small for their contexts: all strings are dealt one by one."""
    line = "A line that many documents hold, at the same place in each, with other words after it "
    rows = corpus + [(1000 + k, f"{line}{k * 7919} and so on {k * 104729} it goes for {k % 5} times around and around") for k in range(60)]
    monkeypatch.setattr(S, "SHARD_BYTES", 3000)
    monkeypatch.setattr(S, "OVERFULL", 0)
    check(documents(rows).repartition(4), rows)


def test_an_id_with_several_texts(spark, documents, prose):
    a, b, c = sorted(prose(40) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, f"{c} {c}"), (4, None)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats(documents(rows)).collect())
    size = lambda t: len(t.encode())
    # of 1 the least text, a, takes part; of 4 the only one
    want = [(1, size(a), 0), (1, size(b), 0), (2, size(b), 0), (3, size(a), size(a)), (3, size(a), size(a)), (4, 0, 0), (4, 2 * size(c) + 1, brute([(4, f"{c} {c}")])[4][1])]
    assert got == sorted(want)


def test_induced_order_against_sorting():
    rng = random.Random(4)
    for _ in range(120):
        alphabet = rng.choice([b"ab", b"abc", bytes(range(256)), b"a"])
        base = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
        strings = [base[rng.randint(0, len(base) - 1) :] + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 7))]
        depth = rng.choice([3, 10, 100])
        at, prefix, starts = I.induced_order(strings, depth)
        windows = {}
        for a, s in zip(starts, strings):
            for j in range(len(s) - depth + 1):
                windows[int(a) + j] = s[j : j + depth]
        ordered = [windows[p] for p in at.tolist() if p in windows]
        assert ordered == sorted(ordered) and len(ordered) == len(windows)
        groups = {}
        for p, g in zip(at.tolist(), np.cumsum(prefix < depth).tolist()):
            if p in windows:
                groups.setdefault(g, set()).add(windows[p])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(windows.values()))


def test_names_are_sorted_by_the_same_induction():
    rng = random.Random(4)
    for _ in range(200):
        x = np.array([rng.randint(0, rng.choice([0, 1, 2, 50])) for _ in range(rng.randint(1, 60))])
        assert I.order_of_names(x).tolist() == sorted(range(len(x)), key=lambda i, x=x: x[i:].tolist())


def test_a_shard_twenty_times_the_memory(tmp_path, prose):
    """The tuples in memory stay within the budget and a chunk, most are in files, and the order is that of the suffixes."""
    from pyarrow.fs import LocalFileSystem

    part = prose(30).encode()
    strings = [prose(20).encode() + part[k : k + 130] for k in range(120)]
    n = sum(len(s) + 1 for s in strings)
    spool = I.Spool(n // 20, (LocalFileSystem(), str(tmp_path)))
    at, prefix, starts = I.induced_order(strings, 100, spool)
    assert spool.peak <= n // 20 + spool.chunk and spool.spills > 20
    plain = I.induced_order(strings, 100)
    assert (at == plain[0]).all() and (prefix == plain[1]).all() and len(at) == n - 1
    text = b"\0".join(strings) + b"\0"
    inside = [p for p in at.tolist() if p - starts[np.searchsorted(starts, p, "right") - 1] + 100 <= len(strings[np.searchsorted(starts, p, "right") - 1])]
    assert [text[p : p + 100] for p in inside] == sorted(text[p : p + 100] for p in inside)


def test_kept_text():
    mask_source = [S.pack(np.array([2]), np.array([1]))]
    assert S.without_repeats("ab" + "x" * 100 + "cd", mask_source) == "abcd" and S.without_repeats(None, None) is None
