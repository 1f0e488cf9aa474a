import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é.,'\"\n\t\r\x1c　 1中") | st.characters(exclude_categories=["Cs"]), max_size=40)), max_size=6))
def test_encoder_equals_library(texts):
    got = T.encoder_of(PATH, 2).ids(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


def test_small_caches():
    e = T.Encoder(PATH, 2)
    e.chunks.limit = 3
    texts = ["one two three. four, five six", "seven eight\nnine ten!", "one two <|endoftext|> x", "it's 'll a b"] * 3
    for _ in range(3):
        assert [np.frombuffer(g, "<u4").tolist() for g in e.ids(texts)] == [plain(t) for t in texts]


class Counted:
    """A tokenizer whose calls are counted."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode")
        return getattr(self.tokenizer, name)


def test_new_chunks_are_encoded_together():
    """Whatever a chunk is made of, it is encoded with others and once; arrays of texts give what lists give."""
    e = T.Encoder(PATH, 2)
    e.chunks.tokenizer = counted = Counted(e.chunks.tokenizer)
    texts = [" ".join(f"{c}{k}{d}" for k in range(300)) + f"\n{c}9,\n{d}" for c in "aé#" for d in ("", "'s", "...", "中")]
    want = [plain(t) for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in e.ids(texts)] == want and counted.calls < 100
    before = counted.calls
    some = pa.array([None, *texts, "", "a1\t b"]).slice(2)
    assert [np.frombuffer(g, "<u4").tolist() for g in e.ids(some)] == want[1:] + [plain(""), plain("a1\t b")]
    assert counted.calls - before < 5


def test_portions(monkeypatch):
    monkeypatch.setattr(T, "PORTION", 50)
    monkeypatch.setattr(T, "ROWS", 4)
    rows = [(None if k == 3 else k, None if k % 5 == 0 else "é" * (k % 7)) for k in range(40)]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[a:b]], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for a, b in ((0, 0), (0, 13), (13, 14), (14, 40))]
    got = list(T.portions(iter(batches)))
    assert [r for ids, texts in got for r in zip(ids.to_pylist(), texts.to_pylist())] == rows and 2 < len(got) < 10


def test_round_trip(spark, documents, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_CHARS", 3000)
    rows = [(k * 7 % 101, prose(k % 50)) for k in range(100)] + [(500, None), (501, ""), (502, "x" * 50_000), (None, "no id"), (503, "same"), (503, "same")]
    folder, shards = T.write_tokens(documents(rows), PATH, 2, f"file://{tmp_path}/tok")
    assert len(shards) > 1 and sum(n for _, n, _ in shards) == len(rows)
    got = sorted(T.read_digest(spark, folder, shards).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for g, (i, text) in zip(got, ordered):
        ids = plain(text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_another_tokenizer(spark, documents, tmp_path):
    """A vocabulary that drops white space and cases: chunks would give other ids, so texts are encoded whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    rows = [(1, "One two  three."), (2, "lines\nof text, it's 5 o'clock"), (3, None)]
    folder, shards = T.write_tokens(documents(rows), path, 2, f"file://{tmp_path}/tok")
    for g in T.read_digest(spark, folder, shards).collect():
        ids = other.encode(dict(rows)[g.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    assert T.Encoder(path, 2).chunks is None and T.Encoder(PATH, 2).chunks is not None


def test_hot_ids_and_many_shards(spark, documents, prose, tmp_path, monkeypatch):
    """An id and the missing id hold a third of all rows each, and there are more shards than quantiles at once."""
    monkeypatch.setattr(T, "SHARD_CHARS", 2000)
    monkeypatch.setattr(T, "QUANTILES", 4)
    rows = [(40, prose(20)) for _ in range(80)] + [(None, prose(20)) for _ in range(80)] + [(k, prose(20)) for k in range(80)]
    folder, shards = T.write_tokens(documents(rows), PATH, 2, f"file://{tmp_path}/tok")
    assert sum(n for _, n, _ in shards) == len(rows) and len(shards) > 8 and max(n for _, n, _ in shards) < len(rows) / 4
    got = sorted(T.read_digest(spark, folder, shards).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(-1 if i is None else i for i, _ in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_one_document_and_damage(spark, documents, tmp_path):
    folder, shards = T.write_tokens(documents([(1, "a b c"), (2, "d e")]), PATH, 2, f"file://{tmp_path}/tok")
    (name,) = [p for p in (tmp_path / "tok").iterdir() if p.suffix == ".dict"]
    reader = T.ShardReader(folder, shards[0][0], name.read_bytes())
    assert np.frombuffer(reader.ids(1), "<u4").tolist() == plain("d e")
    with pytest.raises(ValueError):
        T.ShardReader(folder, shards[0][0], b"another dictionary")


def test_empty(spark, documents, tmp_path):
    folder, shards = T.write_tokens(documents([]), PATH, 2, f"file://{tmp_path}/tok")
    assert shards == []
