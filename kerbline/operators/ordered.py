"""Ordered computations (running totals, numbering) over groups of any size.

A window function gathers a whole group in one task. Here the rows are first range-partitioned by
(group, order), so that a large group spreads over many partitions of even size; each partition
computes its part, and what earlier partitions carry over is one row per partition and group. The
range-partitioned rows are written to a table, because the partition number is part of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.operators.joins import null_safe_join
from kerbline.operators.store import materialize

PART = "_part"


@dataclass(frozen=True)
class Sharded:
    df: DataFrame
    group: tuple[str, ...]
    order: tuple[str, ...]

    def window(self):
        return Window.partitionBy(*self.group, PART).orderBy(*self.order)

    def backward_window(self):
        """The rows in opposite order. Looking ahead is a running frame here; a frame that ends at the
        last row would be evaluated anew for every row."""
        return Window.partitionBy(*self.group, PART).orderBy(*[F.desc_nulls_last(c) for c in self.order])

    def carry_window(self):
        return Window.partitionBy(*self.group).orderBy(PART)

    def backward_carry_window(self):
        return Window.partitionBy(*self.group).orderBy(F.desc(PART))


def shard(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> Sharded:
    """Cut ``df`` into ordered partitions."""
    ranged = df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id())
    return Sharded(materialize(ranged, "ranged"), tuple(group), tuple(order))


def running_total(sharded: Sharded, weight: Column, name: str) -> DataFrame:
    """Cumulative sum of ``weight`` within each group, in order, this row included."""
    inclusive = sharded.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sharded.df.withColumn(name, F.sum(weight).over(inclusive))
    before = sharded.carry_window().rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sharded.df.groupBy(*sharded.group, PART).agg(F.sum(weight).alias("_total"))
        .withColumn("_carried", F.sum("_total").over(before)).drop("_total")
    )
    return (
        null_safe_join(local, carried, [*sharded.group, PART])
        .withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0)))
        .drop("_carried", PART)
    )


#: A group of so many rows is put in order by one task, if all groups are known to be no larger.
WINDOW_ROWS = 1_000_000


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, stored: bool = False) -> DataFrame:
    """1-based row number within each group; ``order`` must be unique within the group.

    ``stored`` says that ``df`` is read from a table. Its groups are then counted first, and without a large one a window does
    it all: no rows are written and sorted twice.
    """
    if stored:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if largest <= WINDOW_ROWS:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return running_total(shard(df, group, order), F.lit(1).cast("long"), name)
