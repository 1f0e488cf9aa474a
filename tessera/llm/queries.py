"""The registered queries of the corpus operators: opN_<name>(spark, sf_dir) and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import curriculum, decontaminate, graph_dedup, language_mixture, lpt_sharding, ngram_join, pii, quality, suffix_dedup, token_files
from tessera.llm.common import settled


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, shards = token_files.write_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_digest(spark, folder, shards)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, sf_dir))


def op7_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_sharding.shard_by_lpt(_documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.curriculum(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_documents(spark, sf_dir))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "proportions")


def _settled(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: settled(spark, name, lambda: query(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The whole result of each is written to the shared folder, and the session's settings stay as they were."""
    every = [op1_decontaminate, op2_token_files, op3_quality, op4_graph_dedup, op5_suffix_dedup, op6_ngram_join, op7_lpt_sharding, op8_curriculum_mix, op9_pii, op10_language_mixture]
    return {q.__name__: _settled(q.__name__, q) for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op8_curriculum_mix": curriculum.ORACLE}
