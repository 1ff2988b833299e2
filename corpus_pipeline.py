"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbline.llm.byte_bpe import encode_documents, read_ranks
from kerbline.llm.decontamination import drop_leaks
from kerbline.llm.ngram_join import keep_first
from kerbline.llm.rule_ensemble import keep_good
from kerbline.llm.secret_scan import mask_secrets
from kerbline.llm.texts import table
from kerbline.operators.store import replacing, scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts good."""
    return keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return mask_secrets(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of ids and decoded bytes."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]
#: Trained rules, MinHash bands, retrieval, Markov models and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder through all stages. What each returned stays in the shared folder until the next run or the session's end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with replacing(spark, f"pipeline of {sf_dir}"):
        folder = scratch_path(spark, "pipeline")
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
