"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens. Each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylog.llm import line_dedup, mixing, quality_rules, sentencepiece_codec, shingle_dedup
from quarrylog.llm.common import table
from quarrylog.plans.lineage import ensure_checkpoint_dir, remove_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject: those of few words (null and empty texts, too) among them."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated runs of lines; every row stays, null texts stay null."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike (SimHash's links that the exact similarity confirms, then all that it leaves apart), the one of the least id; empty texts are alike, null ids come last."""
    return shingle_dedup.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target takes it; rows without words are not taken, a null source is one of its own."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the pieces of the text, that decode to it; null and empty texts have none."""
    codec = sentencepiece_codec.load_codec(sentencepiece_codec.default_model_file())
    return sentencepiece_codec.encode_documents(docs.select("doc_id", "source", "text"), codec)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("mixing", mixture), ("sentencepiece", tokens)]
#: SQL has neither XXH64 nor the unigram search; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Empty tables give empty ones at every stage; columns of other names are carried to the last but one."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")  # its successor is written; the last one is what run() returns
    return docs
