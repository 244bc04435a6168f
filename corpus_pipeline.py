"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal data,
packing. Each stage reads what its predecessor wrote as Parquet; all but the last keep the columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import decontamination, jaccard_join, language_id, packing, pii
from quillspark.llm.common import remainder, table, without
from quillspark.llm.queries import tokenizer_path
from quillspark.session import arrow_batches, ensure_checkpoint_dir, materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no determined language: without a text, or without a letter."""
    model = language_id.train(docs, remainder(F.col("doc_id"), 5) != 0)
    rejected = language_id.identify(docs, model).where(F.col("lang_pred") == language_id.UNDETERMINED)
    with arrow_batches(spark):
        rejected = materialize(rejected.select("doc_id"))
    return without(docs, rejected)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain benchmark passages."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents into sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", known_language), ("jaccard_join", one_of_each_class), ("decontamination", decontaminated),
          ("pii", redacted), ("best_fit_packing", packed)]

#: Learned models and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
