"""Licence scans: passages compared to licence templates by the Dice coefficient of their word bigrams.

A passage is a line, a paragraph of several lines (paragraphs end at an empty line), or a whole text of several
paragraphs. It is normalised to lower-case words of letters and digits. Two bounds come before the comparison, both
exact: sizes a and b can reach a coefficient t only if a lies in [b * t / (2 - t), b * (2 - t) / t], and then more than
t / (2 - t) of a template's bigrams must be in the passage, so that some anchor word has to be: a set of words that
touch the remaining share of bigrams.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.llm.license_templates import TEMPLATES

SIMILARITY = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"


def template_words(wording: str) -> list[str]:
    return re.findall(r"[^\W_]+", wording.lower())


def template_bigrams(wording: str) -> list[str]:
    words = template_words(wording)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(wording: str, similarity: float = SIMILARITY) -> list[str]:
    """Long words of a template, enough of them that no passage without any can be similar to it."""
    bigrams = [b.split() for b in template_bigrams(wording)]
    spare = len(bigrams) - math.ceil(len(bigrams) * similarity / (2 - similarity) - 1e-9)
    chosen: list[str] = []
    for word in sorted({w for b in bigrams for w in b}, key=lambda w: (-len(w), w)):
        if sum(any(w in chosen for w in b) for b in bigrams) > spare:
            break
        chosen.append(word)
    return chosen


def sizes(n: int, similarity: float = SIMILARITY) -> range:
    """The numbers of bigrams that a passage similar to a template of ``n`` can have."""
    share = similarity / (2 - similarity)
    return range(max(1, math.ceil(n * share - 1e-9)), math.floor(n / share + 1e-9) + 1)


def _by_size(spark: SparkSession, templates, similarity: float) -> DataFrame:
    """For each number of bigrams the templates that a passage of that size may be similar to."""
    candidates: dict[int, list[str]] = {}
    for licence, name, wording in templates:
        for n in sizes(len(template_bigrams(wording)), similarity):
            candidates.setdefault(n, []).append(f"{licence} {name}")
    names = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(n).alias("n_bigrams"), F.array(*map(F.lit, found)).alias("names"))
        for n, found in candidates.items()))))
    wordings = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(f"{licence} {name}").alias("name"), F.lit(licence).alias("license"), F.lit(name).alias("template"),
                 F.array(*map(F.lit, template_bigrams(wording))).alias("template_bigrams"))
        for licence, name, wording in templates))))
    return names.select("n_bigrams", F.explode("names").alias("name")).join(F.broadcast(wordings), "name").groupBy("n_bigrams").agg(
        F.collect_list(F.struct("license", "template", "template_bigrams")).alias("candidates"))


def words_of(passage: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(passage), NOT_WORD, " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                        lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.array_distinct(pairs)


def passages_of(text: Column) -> Column:
    """Lines, paragraphs of several lines, and the text itself where it has several paragraphs, with their number in their kind."""
    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), p.alias("passage")))

    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    several = F.filter(numbered("paragraph", paragraphs), lambda p: F.contains(p["passage"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(numbered("line", F.split(text, "\n")), several, numbered("text", whole))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES,
                  similarity: float = SIMILARITY) -> DataFrame:
    """Per passage that is similar to a template: key, kind and number of the passage, the best template and its coefficient.

    Of equal coefficients the first licence and template by name wins. Null and empty texts, and passages of fewer than
    two words, have no rows. Each row of ``docs`` is scanned by itself without a shuffle, so repeated rows repeat
    their results and keys may be null. Templates are a list written by hand; the table by size is small and broadcast.
    """
    needed = F.array(*(F.lit(w) for w in sorted({a for _, _, wording in templates for a in anchors(wording, similarity)})))

    def once(column: Column) -> Column:
        # A generated column is computed once, however often it is referred to.
        return F.explode(F.array(column))

    passages = (
        docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"), once(words_of(F.col(text))).alias("all_words"))
        .where(F.arrays_overlap("all_words", needed))
        .select("row_key", F.inline(passages_of(F.col("text"))))
        .select("row_key", "kind", "number", once(words_of(F.col("passage"))).alias("words"))
        .where(F.arrays_overlap("words", needed))
        .select("row_key", "kind", "number", once(bigrams_of(F.col("words"))).alias("bigrams"))
        .withColumn("n_bigrams", F.size("bigrams")))

    def coefficient(candidate: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("bigrams"), candidate["template_bigrams"]))
        return 2 * shared / (F.col("n_bigrams") + F.size(candidate["template_bigrams"]))

    scored = F.transform("candidates", lambda c: F.struct(
        F.round(-coefficient(c), 6).alias("minus"), c["license"].alias("license"), c["template"].alias("template")))
    by_size = _by_size(docs.sparkSession, templates, similarity)
    return (passages.join(F.broadcast(by_size), "n_bigrams").withColumn("best", F.array_min(scored))
            .where(F.col("best.minus") <= -similarity)
            .select(F.col("row_key").alias(key), "kind", F.col("number").cast("long").alias("number"),
                    F.col("best.license").alias("license"), F.col("best.template").alias("template"),
                    (-F.col("best.minus")).alias("dice"), F.col("n_bigrams").cast("long").alias("n_bigrams")))
