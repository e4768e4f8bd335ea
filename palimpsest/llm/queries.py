"""The subpackage's queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import op2_token_files as op

    return op(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import op1_media as op

    return op(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding import op3_embedding_dedup as op

    return op(_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import op4_quality as op

    return op(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import op5_packing as op

    return op(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codec import op6_bpe_round_trip as op

    return op(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import op9_simhash_dedup as op

    return op(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import op10_secrets as op

    return op(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import op7_toxicity as op

    return op(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import op8_language as op

    return op(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_token_files": op2_token_files,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": embedding.ORACLE}
