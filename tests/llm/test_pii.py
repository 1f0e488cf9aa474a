import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain(text):
    """The contract read literally."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in P.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in P.CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in P.PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("aZ09@@..-+_%( )é\n1234567890"), max_size=60))
def test_base_spans_read_literally(text):
    assert P.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["x@y.z@a.b.c", "@a.b@c.d", "a" * 300 + "@b.co", "_" * 500 + "@", "a@b@c.de", "4111 1111 1111 1111", "+1 (212) 555-0100 x", "1.2.3.4.5.6.7.8", "256.1.1.1", "0" * 4000 + ".1.1.1", "a@b." + "c." * 200])
def test_base_cases(text):
    assert P.base_spans(text) == plain(text)


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB29 NWBK 6016 1331 9268 19") and not P.mod97("GB28 NWBK 6016 1331 9268 19")


def test_added_kinds_and_context():
    found = {s.kind: s for s in P.find_pii("My IBAN is GB29 NWBK 6016 1331 9268 19 AND MORE. social security 123-45-6789")}
    assert found["iban"].end - found["iban"].start == 27 and "ssn" in found and not found["ssn"].base
    assert not P.find_pii("part no 123-45-6789 in stock") and not P.find_pii("GB28 NWBK 6016 1331 9268 19")
    near, far = (next(s for s in P.find_pii(t) if s.kind == "card") for t in ("card 4111111111111111", "order 4111111111111111"))
    assert near.score > far.score and far.base  # base spans stay


def test_context_decides_each_added_kind():
    kinds = lambda t: [s.kind for s in P.find_pii(t)]
    assert kinds("GB29 NWBK 6016 1331 9268 19") == ["iban"] and kinds("serial GB29 NWBK 6016 1331 9268 19") == []
    assert kinds("serial of the bank: GB29 NWBK 6016 1331 9268 19") == ["iban"]
    word = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{word}"') == ["secret"] and kinds(f"see {word}") == [] and kinds(f"commit token {word}") == []
    assert kinds("token " + "ab" * 20) == [] and kinds("key anticonstitutionnellement2") == ["secret"]
    scores = [s.score for s in P.find_pii("call +1 212 555 0100, or 4111111111111111, order 4111111111111111")]
    assert all(0 <= x <= 1 for x in scores) and len(set(scores)) > 1


def test_long_texts_and_equal_rows(spark, documents):
    import time

    began = time.perf_counter()
    for t in ("a1" * 300_000, "a1" * 200_000 + "@", "1 " * 300_000, "@" * 300_000, "GB29 " * 100_000, "+1" * 200_000):
        P.find_pii(t)
    assert time.perf_counter() - began < 60
    rows = [(1, "x@y.zz"), (1, "x@y.zz"), (1, "other 10.0.0.1")]
    got = [(r.n_email, r.n_ip, r.scores.count(".")) for r in P.pii_digest(documents(rows)).collect()]
    assert sorted(got) == [(0, 1, 1), (1, 0, 1), (1, 0, 1)]


def test_digest(spark, documents):
    rows = [(1, "write to a.b@c.org or +1 212 555 0100"), (2, None), (3, ""), (4, "é 10.0.0.1"), (None, "x@y.zz"), (5, "clean words")]
    got = {r.doc_id: r for r in P.pii_digest(documents(rows)).collect()}
    assert (got[1].n_email, got[1].n_phone, got[4].n_ip, got[2].spans, got[None].n_email) == (1, 1, 1, "", 1)
    assert got[4].spans == "ip:2:10" and got[4].base_sha256 == hashlib.sha256(b"ip:2:10").hexdigest()
    assert {r.doc_id: len(r.spans) for r in P.pii_spans(documents(rows)).collect()} == {1: 2, 2: 0, 3: 0, 4: 1, None: 1, 5: 0}
    assert P.pii_digest(documents([])).count() == 0
