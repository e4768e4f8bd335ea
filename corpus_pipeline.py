"""A corpus pipeline over the documents of a folder, stage by stage.

Each stage works on all rows that the stage before it kept; every stage but the
last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import language, packing, quality, secrets, simhash
from palimpsest.llm.common import shared_path, written
from palimpsest.llm.queries import tokenizer_path

#: Language scores below this reject a document, as having no language does.
LEAST_LANGUAGE_SCORE = 0.1


def sample_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw by importance; what the target model can't explain goes."""
    ratio = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = written(quality.importance(docs, ratio), "importance")
    return quality.keep_sampled(docs, ratio, quality.threshold(weights))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return language.keep_identified(docs, language.train(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by their kind."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in sequences of 2048 ids."""
    return packing.op5_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", sample_quality),
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Hashed models, codes and byte-pair encoding are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
