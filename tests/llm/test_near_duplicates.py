import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import components, ngram_join, queries
from tests.conftest import SMALL
from tests.llm.fixtures import ODD, docs, prose


def plain(rows, size=5, similarity=0.8):
    """For each row (class id, links) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = min(size, len(words))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set())
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(near[i])))
    return sorted(out, key=str)


def changed(text, seed, n):
    drawn, words = random.Random(seed), text.split()
    for _ in range(n):
        words[drawn.randrange(len(words))] = f"new{drawn.random()}"
    return " ".join(words)


def copies(seed=1):
    base = [prose(s, 200) for s in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t) for i, t in enumerate(base[:3])]
    rows += [(100 * b + 20 + k, changed(base[b], k, n)) for b in range(4) for k, n in enumerate([1, 1, 2, 3, 4, 6, 8, 12])]
    return rows


def test_bands_reach_the_recall_with_the_most_rows():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8 ** rows) ** bands >= 0.999
    longer = int(np.ceil(np.log(0.001) / np.log(1 - 0.8 ** (rows + 1))))
    assert longer * (rows + 1) > 256
    assert ngram_join.choose_bands(1.0, 0.9, 8) == (1, 8)


def test_minhash_estimates_the_similarity():
    sketcher = ngram_join.Sketcher(64, 1)
    for seed in range(4):
        a, b = ngram_join.gram_sets([prose(seed, 300), changed(prose(seed, 300), seed, 8)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sketcher.band_hashes(a) == sketcher.band_hashes(b)).mean() - true) < 0.2


def test_gram_sets_of_short_texts():
    none, one, same, five = ngram_join.gram_sets([None, "a", " a\n", "a b c d e"])
    assert len(none) == 0 and len(one) == len(five) == 1 and one.tolist() == same.tolist() != five.tolist()


@pytest.mark.parametrize("part_grams", [250_000, 400])
def test_links_and_classes_equal_all_pairs(spark, monkeypatch, part_grams):
    monkeypatch.setattr(ngram_join, "PART_GRAMS", part_grams)  # 400: clusters meet in several parts
    rows = copies() + ODD
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert found == plain(rows)


def test_one_of_each_class_stays(spark):
    rows = docs(spark, copies() + ODD)
    kept = ngram_join.keep_first(rows)
    assert kept.columns == rows.columns
    found = kept.collect()
    assert not {r.doc_id for r in found} & {10, 11, 12, 20, 120, 220, 320}
    texts = [r.text for r in found]
    assert texts.count("one") == 1 and texts.count(None) == 2 and len([t for t in texts if t == "no id here"]) == 1


def test_empty_table(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    assert ngram_join.keep_first(docs(spark, [])).count() == 0


def test_components_equal_union_find(spark):
    drawn = random.Random(5)
    edges = [(drawn.randrange(300), drawn.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(2000, 2000 + i) for i in range(1, 60)] + [(7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a int, b int"), "test").collect()))
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert found == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


def test_a_hot_key_meets_its_group_without_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_KEYS", 20)
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2 + i % 50, i) for i in range(150)] + [(99, 1)], "u int, v int")
    groups = rows.where("u < 99").groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows_of_key"))
    joined = components.join_groups(rows, "u", groups, "test")
    assert joined.columns == ["u", "v", "m"] and joined.count() == 3150
    assert joined.where("m <> if(u = 1, 0, u - 2)").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = components.join_groups(rows, "u", groups, "test")
        largest = joined.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert largest < 3000 / 2  # of eight tasks


def test_columns_of_any_name(spark):
    rows = [(i, t, i, str(i), -i) for i, t in copies()]
    odd = spark.createDataFrame(rows, "digest int, text string, row_id int, `a.b` string, __row int")
    found = sorted((r.digest, r.class_id, r.n_links) for r in ngram_join.near_duplicates(odd, "digest").collect())
    assert found == sorted(plain(copies()))
    kept = ngram_join.keep_first(odd, "digest")
    assert kept.columns == odd.columns
    assert all(r.row_id == r.digest == -r["__row"] and r["a.b"] == str(r.digest) for r in kept.collect())
    for name in ("bands", "n_grams", "cluster", "key"):
        renamed = odd.select(F.col("digest").alias(name), "text")
        assert ngram_join.near_duplicates(renamed, name).columns[0] == name


def test_query_two_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in queries.op2_ngram_join(spark, SMALL).collect()), key=str)
    assert found == plain(rows)
