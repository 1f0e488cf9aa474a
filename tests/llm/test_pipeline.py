import gc

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import common
from tessera.llm.curriculum import in_training_order
from tessera.llm.ngram_join import sketch
from tessera.llm.token_files import write_tokens


def test_stages(spark, documents, prose, tmp_path):
    item = prose(30)
    rows = [(k, prose(50), "en", f"s{k % 4}") for k in range(80)]
    rows += [(100 + k, rows[5][1], "en", "s1") for k in range(10)] + [(200, f"{prose(20)} {item} {prose(20)}", "en", "s2"), (201, "12 34", "en", "s0"), (202, None, "en", "s0"), (203, "", "en", "s0")]
    documents(rows).drop("size", "shard", "band", "target").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert seen["language_id"] == {r[0] for r in rows} - {201, 202, 203}
    assert seen["ngram_join"] == seen["language_id"] - set(range(100, 110))
    assert seen["decontaminate"] == seen["ngram_join"] - {200}
    mixed = in_training_order(spark.read.parquet(f"{tmp_path}/decontaminate"), 2).count()
    assert docs.count() == mixed and seen["token_files"] == seen["mix"]
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))


def test_edge_rows_and_clashing_columns(spark, documents, prose, tmp_path):
    """Null ids, repeated rows, an empty text and extra columns named like the operators' own."""
    rows = [(k, prose(30), "en", "s") for k in range(20)] + [(3, "other text of an id that comes twice", "en", "s"), (None, prose(30), "en", None), (None, None, None, None), (50, "", "en", "s")]
    rows += [rows[7], rows[7]]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "ngram_join":
            held = [r.doc_id for r in docs.select("doc_id").collect()]
            assert held.count(7) == 1 and held.count(3) == 2 and held.count(None) == 1 and 50 not in held
    assert docs.count() > 0


def test_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_workers_drop_what_other_stages_kept(spark, documents, prose):
    """The encoder of the token files stays for its own stage's tasks alone; workers live on beside the stages that follow."""
    docs = documents([(k, prose(30)) for k in range(64)]).repartition(32)

    def probe(batches):
        for b in batches:
            encoders = sum(type(o).__name__ == "Encoder" and type(o).__module__ == "tessera.llm.token_files" for o in gc.get_objects())
            yield pd.DataFrame({"encoders": [encoders] * len(b)})

    def encoders():
        return spark.range(0, 64, 1, 32).mapInPandas(probe, "encoders long").agg(F.max("encoders")).first()[0]

    write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    sketch(docs).count()
    assert encoders() == 0


def test_what_a_task_keeps_and_gives_back(monkeypatch):
    made, given = [], []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    make = lambda *args: made.append(args) or object()
    step = lambda batches: ((b, common.kept(make, 1)) for b in batches)
    first = list(common.lean(step, keeps=True)([1, 2]))
    again = list(common.lean(step, keeps=True)([3]))
    assert [b for b, _ in first + again] == [1, 2, 3] and len({x for _, x in first + again}) == 1 and len(given) == 2
    assert list(common.lean(iter)([4])) == [4]
    common.kept(make, 1), common.kept(make, 2), common.kept(make, 2), common.kept(make, 1)
    assert made == [(1,), (1,), (2,), (1,)]
    common.let_go()
