"""The registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import conversation_repair
from kerbline.llm.byte_bpe import encode_documents, read_ranks
from kerbline.llm.decontamination import find_leaks
from kerbline.llm.license_scan import scan_licenses
from kerbline.llm.ngram_join import near_duplicates
from kerbline.llm.oracle import license_scan_sql, url_filter_sql
from kerbline.llm.periodic_runs import run_digests
from kerbline.llm.risk_rules import judge
from kerbline.llm.rule_ensemble import score_quality
from kerbline.llm.secret_scan import scan_secrets
from kerbline.llm.suffix_dedup import remove_repeats
from kerbline.llm.texts import table
from kerbline.llm.toxicity import score_toxicity
from kerbline.llm.url_filter import DEFAULT_PATTERNS, address_rule, judge_urls
from kerbline.llm.wrappers import extract_pages
from kerbline.operators.store import replacing

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the URL query states.
ADDRESS_RULES = tuple(address_rule(*r) for r in (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "failed_rules", "kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return joined.select("doc_id", "class_id", "n_links", "n_copies")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), ADDRESS_RULES + DEFAULT_PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN,
                            with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def run(query: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's result. Scratch tables that its last run in this session wrote are deleted."""
    with replacing(spark, f"{query.__name__} of {sf_dir}"):
        return query(spark, sf_dir)


QUERIES: dict[str, Query] = {query.__name__: partial(run, query) for query in (
    op1_quality_rules, op2_ngram_join, op3_url_filter, op4_byte_bpe, op5_toxicity, op6_secret_scan, op7_decontamination,
    op8_html_extraction, op9_quality_classifier, op10_license_scan, op11_periodic_runs,
    op12_suffix_dedup, op13_conversation_repair)}
#: The other queries have no SQL form: they rest on trained models, MinHash, retrieval, tokens, page trees, suffixes or
#: parses, and periodic runs of all lags would make rows with the square of a text's words.
ORACLE: dict[str, str] = {
    "op3_url_filter": url_filter_sql(ADDRESS_RULES + DEFAULT_PATTERNS),
    "op10_license_scan": license_scan_sql(),
}
