"""Counts over whole texts that the quality operators rest on."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.texts import SLICE_ROWS, WORD

SYMBOLS = "#*$%&|<>"
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_capitals",
          "n_digits", "n_marks")


def repeated_words(numbers: np.ndarray) -> int:
    """Words, given as numbers below 2**21, that lie in a window of three found twice or more."""
    if len(numbers) < 4:
        return 0
    windows = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift:len(windows) + shift] |= again
    return int(covered.sum())


def repeated_words_of_many(words: list[str]) -> int:
    """The same for texts of more different words than 21 bits can number."""
    seen: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for at, window in enumerate(zip(words, words[1:], words[2:])):
        first = seen.setdefault(window, at)
        if first != at:
            covered[first:first + 3] = covered[at:at + 3] = b"\x01\x01\x01"
    return sum(covered)


def count(text: str | None) -> tuple[int, ...]:
    """The counts of a text in the order of ``COUNTS``; all 0 for null and empty texts."""
    words = WORD.findall(text) if text else []
    if not words:
        return (0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    lines = text.split("\n")
    with_words = [line for line in lines if WORD.search(line)]
    number: dict[str, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    repeats = repeated_words(numbers) if len(number) < 1 << 21 else repeated_words_of_many(words)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(with_words) - len(set(with_words)),
            repeats, len(with_words), len(number), sum(map(len, CAPITALS.findall(text))),
            sum(map(text.count, "0123456789")), sum(map(text.count, "!?")))


def counts_of(text: Column) -> Column:
    """A struct of the counts of a text column, computed in Python once per row."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def run(texts: pa.Array) -> pa.Array:
        found = [count(t) for at in range(0, len(texts), SLICE_ROWS) for t in texts.slice(at, SLICE_ROWS).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64()) for _ in COUNTS]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    # Declared non-deterministic so that no filter runs it a second time.
    return F.arrow_udf(run, ", ".join(f"{c} bigint" for c in COUNTS)).asNondeterministic()(text)


def labelled(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """One 0/1 label per key: the mean of its labels, rounded; rows without key or label fall away."""
    given = labels.select(key, F.col(label).cast("double").alias("label")).where(F.col(key).isNotNull() & F.col("label").isNotNull())
    return given.groupBy(key).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
