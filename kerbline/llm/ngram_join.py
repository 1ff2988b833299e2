"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes a set of hashed word n-grams, its digest and its band hashes. Texts of one digest are copies
   and go on as one class.
2. Classes that share a band hash are candidates. Each bucket links its members to its least one, which makes as many
   links as members and no pairs; connected buckets form a cluster.
3. A cluster is cut into parts of bounded size; every two parts meet in one task group, which holds their n-gram sets
   and compares all their texts in blocks. No pair becomes a row: a group hands on a number of links for each class and
   the links of a spanning forest.
4. The components of the forests are the classes of near duplicates.

Bands and rows are chosen for a target recall at the threshold; a pair in one cluster is compared whether or not the pair
itself shares a bucket.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.llm.components import components, join_groups
from kerbline.llm.texts import map_rows, quoted, words_of
from kerbline.operators.store import materialize

GRAM, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
#: n-grams of a part of a cluster, in expectation; two parts meet in one group.
PART_GRAMS = 250_000
SEED = 20_240_601
MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that reach the recall at the similarity within ``most`` hashes."""
    for rows in range(most, 0, -1):
        chance = similarity ** rows
        if chance >= 1:
            return 1, rows
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-chance))) if chance > 1e-12 else most + 1
        if bands * rows <= most:
            return max(1, bands), rows
    raise ValueError(f"{most} hashes can't reach a recall of {recall} at {similarity}")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str | None], size: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, one without words has none."""
    words = [words_of(t) for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=True).astype(np.uint64) if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        own = hashes[at:at + len(ws)]
        at += len(ws)
        n = min(size, len(ws))
        count = len(ws) - n + 1 if n else 0
        gram = np.full(count, n, np.uint64)
        for k in range(n):
            gram = gram * MIX + own[k:k + count]
        out.append(np.unique(mixed(gram)))
    return out


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        drawn = np.random.default_rng(SEED)
        self.factor = drawn.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shift = drawn.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.weigh = (drawn.integers(0, 1 << 63, rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.band = np.arange(1, bands + 1, dtype=np.uint64) * MIX

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)[:, None]
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(least, (x[at:at + 256] * self.factor + self.shift).min(0), out=least)
        parts = mixed(least.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)) * self.weigh
        return mixed(parts.sum(1, dtype=np.uint64) + self.band).view(np.int64)


def row_id(key: str, text: str) -> Column:
    """Tells rows apart by key and text, of which each may be null."""
    name, written = quoted(key), quoted(text)
    return F.unhex(F.md5(F.concat_ws("\x1f", name.isNull().cast("string"), name.cast("string"),
                                     written.isNull().cast("string"), written)))


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per row (key, row_id, text): key, row_id, digest and size of the n-gram set (null digest for none), and the band hashes."""
    kind = docs.schema["key"].dataType.simpleString()

    def start():
        sketcher = Sketcher(bands, rows)

        def handle(part):
            for (name, row, _), grams in zip(part, gram_sets([t for _, _, t in part], size)):
                if len(grams):
                    yield name, row, hashlib.md5(grams.tobytes()).digest(), len(grams), sketcher.band_hashes(grams).tolist()
                else:
                    yield name, row, None, 0, None
        return handle

    return map_rows(docs.select("key", "row_id", "text"),
                    f"key {kind}, row_id binary, digest binary, n_grams bigint, bands array<bigint>", start)


def compare(left: list[np.ndarray], right: list[np.ndarray], same: bool, similarity: float):
    """For each left set the places of the right sets that are similar to it; of one list against itself, the later ones."""
    values, places = np.unique(np.concatenate(right), return_inverse=True)
    sizes = np.array([len(g) for g in right])
    offsets = sizes.cumsum() - sizes
    flag = np.zeros(len(values), np.int32)
    for at, grams in enumerate(left):
        spot = np.searchsorted(values, grams)
        spot = spot[values[np.minimum(spot, len(values) - 1)] == grams]
        flag[spot] = 1
        shared = np.add.reduceat(flag[places], offsets)
        flag[spot] = 0
        near = shared >= similarity * (len(grams) + sizes - shared) - 1e-9
        if same:
            near[:at + 1] = False
        yield at, np.flatnonzero(near)


def links_of_group(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Rows (a, b, n): n links that a class has by this group, with b null; or a link a - b of the group's forest, with n 0."""
    group = group.sort_values("digest", ignore_index=True)
    p, q = group["p"].iloc[0], group["q"].iloc[0]
    left = np.flatnonzero(group["part"] == p)
    right = left if p == q else np.flatnonzero(group["part"] == q)
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "n": []})
    grams = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    copies = group["copies"].to_numpy(np.int64)
    links, component, forest = np.zeros(len(group), np.int64), np.arange(len(group)), []
    for at, near in compare([grams[i] for i in left], [grams[i] for i in right], p == q, similarity):
        if not len(near):
            continue
        own, others = left[at], right[near]
        links[own] += copies[others].sum()
        links[others] += copies[own]
        met, first = np.unique(component[others], return_index=True)
        for number, other in zip(met, others[first]):
            if number != component[own]:
                forest.append((own, other))
                component[component == number] = component[own]
    digest = group["digest"].to_numpy()
    linked = np.flatnonzero(links)
    return pd.DataFrame({"a": [*digest[linked], *(digest[i] for i, _ in forest)],
                         "b": [*[None] * len(linked), *(digest[j] for _, j in forest)],
                         "n": [*links[linked].tolist(), *[0] * len(forest)]})


@contextmanager
def early_filter(spark: SparkSession):
    """Let Spark drop, by a Bloom filter of bounded size, rows that a join will not keep before it shuffles them, whatever the scan's size."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = GRAM, similarity: float = SIMILARITY,
                    recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: key, row_id, class_id, n_links, n_copies and first.

    class_id is the least key of the rows joined by links (null if none has a key); n_links is the number of other rows whose
    n-gram set is similar, copies among them; n_copies of rows with an equal set, itself among them; first marks the row (or
    repeated rows) that stands for the class. A text without words has no n-grams: its row is a class of its own without
    links, even if there are several. Words are runs without white space, case kept. Key and text may have any
    name but that of a result column; other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(quoted(key).alias("key"), row_id(key, text).alias("row_id"), quoted(text).alias("text"))
    rows_ = materialize(sketch(docs, size, *choose_bands(similarity, recall)), "sketches")
    ranked = F.struct(F.col("key").isNull().alias("without"), "key", "row_id")
    classes = materialize(rows_.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(ranked).alias("least"), F.min("n_grams").alias("n_grams")), "classes")

    # Copies have equal bands: the row that stands for the class brings them in.
    bucketed = rows_.join(classes.select("digest", F.col("least.row_id").alias("row_id")), ["digest", "row_id"], "left_semi").dropDuplicates(["digest", "row_id"])
    bucketed = bucketed.select("digest", F.explode("bands").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(
        F.min("digest").alias("root"), F.max("digest").alias("last"), F.count("*").alias("rows_of_key")).where("root < last").drop("last")
    clusters = components(join_groups(bucketed, "bucket", shared, "buckets").select(
        F.col("digest").alias("a"), F.col("root").alias("b")), "candidate-links")

    members = materialize(clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster")).join(classes, "digest"), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n_grams") / PART_GRAMS).cast("int").alias("parts"), F.count("*").alias("rows_of_key"))
    placed = materialize(join_groups(members, "cluster", sizes, "cluster-sizes").select(
        "digest", "cluster", "parts", "copies", F.col("least.row_id").alias("row_id"),
        F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part")), "cluster-parts")

    # The condition always holds; Spark builds its early filter only from a side that has one.
    found = docs.select("row_id", "text").join(placed.where("parts > 0"), "row_id")
    found = found.select("digest", "cluster", "parts", "copies", "part", "text")
    held = map_rows(found, "digest binary, cluster binary, parts int, copies bigint, part int, grams binary", lambda: lambda part: (
        (*row[:-1], grams.tobytes()) for row, grams in zip(part, gram_sets([row[-1] for row in part], size))))
    # Repeated rows of one key and text come once.
    held = held.groupBy("digest", "cluster", "parts", "copies", "part").agg(F.first("grams").alias("grams"))
    meeting = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        F.least("part", j).alias("p"), F.greatest("part", j).alias("q")))
    groups = held.select("cluster", "digest", "part", "copies", "grams", F.inline(meeting)).groupBy("cluster", "p", "q")
    with early_filter(docs.sparkSession):
        links = materialize(groups.applyInPandas(lambda g: links_of_group(g, similarity), "a binary, b binary, n bigint"), "links")

    roots = components(links.where("b IS NOT NULL").select("a", "b"), "verified-links")
    counted = links.groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("links"))
    joined = classes.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").join(counted, "digest", "left")
    joined = materialize(joined.select("digest", "copies", "least", F.coalesce("root", "digest").alias("root"),
                                       F.coalesce("links", F.lit(0)).alias("links")), "joined-classes")
    heads = joined.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("rows_of_key"))
    named = materialize(join_groups(joined, "root", heads, "heads").select("digest", "head", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")),
                        "named-classes")
    none = F.col("digest").isNull()
    return rows_.select("key", "row_id", "digest").join(named, "digest", "left").select(
        F.col("key").alias(key), "row_id", F.when(none, F.col("key")).otherwise(F.col("head.key")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (none | (F.col("row_id") == F.col("head.row_id"))).alias("first"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all columns of ``docs``, whatever their names; of repeated rows one stays, of no rows none."""
    own = "row_id"
    while own.lower() in map(str.lower, docs.columns):
        own += "_"
    plain = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    chosen = near_duplicates(plain, "key", similarity=similarity).where("first").select(F.col("row_id").alias(own)).distinct()
    known = docs.withColumn(own, row_id(key, text)).join(chosen, own, "left_semi")
    return known.dropDuplicates([own]).drop(own)
