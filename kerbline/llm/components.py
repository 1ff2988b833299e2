"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.operators.store import materialize

#: Keys with more than this part of all rows are hot; there are fewer of them than this.
HOT_KEYS = 2000


def join_groups(rows: DataFrame, key: str, groups: DataFrame, label: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per key), whatever part of the rows one key holds; rows without group go.

    ``groups`` counts in ``rows_of_key`` at least the rows its key has here. It is written; its hot keys, of which there are
    fewer than ``HOT_KEYS``, are broadcast, and rows of these are dealt by all their columns in the join with the other groups.
    """
    groups = materialize(groups, label)
    values = [c for c in groups.columns if c not in (key, "rows_of_key")]
    limit = (groups.agg(F.sum("rows_of_key")).first()[0] or 0) / HOT_KEYS
    hot = groups.where(F.col("rows_of_key") > limit).select(key, F.struct(*values).alias("_hot"))
    cold = groups.where(F.col("rows_of_key") <= limit).select(key, F.hash(key).alias("_salt"), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.hash(*rows.columns)).otherwise(F.hash(key)))
    found = marked.join(cold, [key, "_salt"], "left").select(*rows.columns, F.coalesce("_hot", "_cold").alias("_group"))
    return found.where("_group IS NOT NULL").select(*rows.columns, "_group.*")


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("rows_of_key"))
    return join_groups(both.where("v > u"), "u", least, label).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges go from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows_of_key"))
    met = join_groups(edges, "a", least, label)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(met.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node of its component.

    ``edges`` has columns a and b of one orderable type, any direction, repeats allowed; edges of a node to itself are
    ignored. Each round is written to the shared folder. Rounds grow with the logarithm of the longest path; of a round
    only its number of edges and their checksum come to the driver.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = _state(current)
    while state[0]:
        starred = materialize(_large_star(current, f"{label}-least").where("a <> b").distinct(), label)
        current = materialize(_small_star(starred, f"{label}-least").distinct(), label)
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
