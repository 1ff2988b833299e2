"""Reproducible samples and heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def draw(keys: Sequence[str], seed: int) -> Column:
    """A fixed pseudo-random text per key and seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement; ``keys`` identify a row. The draw ignores partitioning."""
    return df.orderBy(draw(keys, seed), *keys).limit(n)


def sample_keys(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct keys, such as tracks."""
    return sample_rows(df.select(*keys).dropna().distinct(), keys, n, seed)


def head_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; rows past the limit are dropped before the shuffle."""
    first = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n).drop("_rank")
