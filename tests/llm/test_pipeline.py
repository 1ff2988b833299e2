import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from kerbline.llm import byte_bpe, decontamination, ngram_join
from tests.conftest import SMALL
from tests.llm.fixtures import docs, prose


def test_stages_in_order_decide_and_the_last_encodes(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "byte_bpe"]
    stage, before, columns = given, {r.doc_id: r for r in given.collect()}, given.columns
    for name, function in corpus_pipeline.STAGES[:4]:
        stage = function(spark, stage, SMALL)
        assert stage.columns == columns
        stage = spark.createDataFrame(stage.collect(), given.schema)
        after = {r.doc_id: r for r in stage.collect()}
        assert set(after) <= set(before) and (len(after) < len(before) or name == "secret_scan")
        if name != "secret_scan":
            assert all(after[i] == before[i] for i in after)
        before = after
    assert ngram_join.near_duplicates(stage).where("n_links > 0").count() == 0
    assert decontamination.find_leaks(stage, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    other = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(found) == set(before)
    for i, r in found.items():
        ids = other.encode_ordinary(before[i].text)
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_odd_documents(spark):
    from tests.llm.fixtures import ODD
    rows = docs(spark, [(i + 10, prose(i, 80, 3)) for i in range(20)] + ODD)
    stage = rows
    for _, function in corpus_pipeline.STAGES[:4]:
        stage = function(spark, stage, SMALL)
        assert stage.columns == rows.columns
    assert corpus_pipeline.STAGES[4][1](spark, stage, SMALL).count() == stage.count()
    empty = docs(spark, [])
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, SMALL).count() == 0
