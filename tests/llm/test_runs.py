import hashlib
import random
import re
import zlib

import pytest

from kerbline.llm import periodic_runs as pr, queries
from tests.conftest import SMALL
from tests.llm.fixtures import ODD, docs, prose


def all_runs(words):
    """Runs by trying every lag at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = None
        for i in range(q, n + 1):
            if i < n and words[i] == words[i - q]:
                start = i - q if start is None else start
            elif start is not None:
                size = i - start
                if size >= max(6, 4 * q) and not any(
                        all(words[start + k] == words[start + k + p] for k in range(size - p)) for p in range(1, q)):
                    out.append((start, size, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    written = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(runs), *(best[0] if best else (None,) * 3), best and 1000 * best[0][1] // best[0][2] or None,
            hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repetitive(r, alphabet):
    words = []
    for _ in range(r.randint(1, 8)):
        block = [r.randrange(alphabet) for _ in range(r.randint(1, 9))]
        if r.random() < 0.3:
            block = block * r.randint(1, 4) + [r.randrange(alphabet)]
        words += (block * r.randint(1, 7))[:200]
        del words[len(words) - r.randrange(3):]
    return words


@pytest.mark.parametrize("alphabet", [1, 2, 3, 6])
@pytest.mark.parametrize("few", [2, 32])
def test_runs_equal_all_lags(alphabet, few, monkeypatch):
    monkeypatch.setattr(pr, "FEW", few)
    r = random.Random(alphabet)
    for _ in range(300):
        words = repetitive(r, alphabet)
        assert sorted(pr.find_runs(words), key=lambda x: (x[0], x[2])) == all_runs(words), words


def test_long_repetitive_texts_take_linear_time():
    r = random.Random(1)
    assert list(pr.find_runs([0] * 300_000)) == [(0, 300_000, 1)]
    assert list(pr.find_runs([i % 997 for i in range(200_000)])) == [(0, 200_000, 997)]
    # A menu line between other words, and a few words in any order.
    menu = [w for _ in range(2000) for w in [*range(12), *(r.randrange(100, 10**6) for _ in range(r.randint(1, 20)))]]
    assert not list(pr.find_runs(menu))
    assert len(list(pr.find_runs([r.randrange(3) for _ in range(60_000)]))) > 50


def test_query_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect()))
    assert len(found) == len(given)
    short = {row[0] for row in given if len(row[1].split()) < 900}
    assert [r for r in found if r[0] in short] == sorted(expected(*row) for row in given if row[0] in short)
    assert sum(r[1] > 0 for r in found) > 5


def test_odd_rows(spark):
    rows = [*ODD, (77, "a b " * 40 + "end"), (77, "a b " * 40 + "end"), (8, "x y z " * 3), (9, "same " * 6)]
    found = sorted((tuple(r) for r in pr.run_digests(docs(spark, rows)).collect()), key=str)
    assert len(found) == len(rows)
    small = [r for r in rows if r[0] != 5]
    assert [r for r in found if r[0] != 5] == sorted((expected(*row) for row in small), key=str)
    five = [r for r in found if r[0] == 5]
    assert [r[1:5] for r in five] == [(1, 0, 30_000, 1)]
    assert pr.run_digests(docs(spark, [])).count() == 0


def test_collapse_keeps_rows_and_columns(spark):
    rows = [*ODD, (70, "intro " + "la di " * 9 + "end", "en"), (71, prose(3, 60))]
    given = docs(spark, rows).withColumnRenamed("score", "a.b")
    done = pr.collapse_runs(given)
    assert done.columns == [*given.columns, "runs"] and done.count() == len(rows)
    row = done.where("doc_id = 70").first()
    assert row.text == "intro la di end" and row.n_chars == 15 and [tuple(r) for r in row.runs] == [(1, 18, 2)]
    same = done.where("doc_id = 71").first()
    assert same.text == prose(3, 60) and same.runs == []
    again = pr.collapse_runs(done)
    assert again.columns == done.columns and again.where("size(runs) > 0").count() == 0
