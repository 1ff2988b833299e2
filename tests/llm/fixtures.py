"""Small tables with the awkward rows every operator must take: nulls, empty and long texts, repeated rows, further columns."""

from __future__ import annotations

import random

LABELS = "doc_id bigint, quality int, toxic int"
# Columns named like results, which operators must not stumble over.
DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, score double, words string, label int, "
        "row string, kind string, bands string, n_words int, counts string")


def prose(seed: int, words: int, lines: int = 1) -> str:
    drawn = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in ("a", "e", "io", "ou") for c in ("n", "st", "ring", "t", "lly")]
    text = [drawn.choice(vocabulary) for _ in range(words)]
    return "\n".join(" ".join(text[i::lines]) for i in range(lines))


def docs(spark, rows):
    """``rows`` of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None,
             "x", 0.5, "w", 1, "r", "k", "b", 1, "c") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"), (None, None), (5, "word " * 30_000), (6, "\x00\x1f é 日本 \U0001F600")]
