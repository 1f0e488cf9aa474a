"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import curriculum, decontaminate, language_mixture, ngram_join, token_files
from tessera.llm.common import Scratch, settled

END_ID = 2


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_mixture.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return curriculum.in_training_order(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them where each document's ids stand."""
    folder, shards = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_digest(spark, folder, shards)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("token_files", write_token_files),
]

#: Learned languages, MinHash and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(name, docs)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they wrote on the way is removed, but for the token files."""
    return settled(spark, "pipeline", lambda: _stages(spark, sf_dir))
