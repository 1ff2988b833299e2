"""Grouped statistics with exact quantiles, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.operators.joins import null_safe_join

Quantile = tuple[str, float, str]  # value column, probability, result name

#: A sketch's ranks are off by at most this part of a group's rows; a bracket holds about four parts.
ACCURACY = 10_000


def summarise(df: DataFrame, group: Sequence[str], aggregates: Sequence[Column],
              quantiles: Sequence[Quantile]) -> DataFrame:
    """``groupBy(group).agg(aggregates)`` plus linearly interpolated quantiles, nulls skipped.

    ``percentile`` keeps every distinct value of a group in one buffer. Here a first aggregation also makes a mergeable sketch of
    each column, of bounded size, which gives two values that a quantile must lie between: a bracket. A second aggregation counts
    what is below the bracket and keeps the values within, each with its number. Only these are put in order: some 4 /
    ACCURACY of a large group, all of a group of few values. Nothing is written in between.
    """
    values = list(dict.fromkeys(value for value, _, _ in quantiles))
    number = {value: k for k, value in enumerate(values)}
    wide = df.select("*", *[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(values)])
    sketches = []
    for value, k in number.items():
        edges = sorted({min(1.0, max(0.0, q + side * 2 / ACCURACY)) for v, q, _ in quantiles if v == value for side in (-1, 1)})
        sketches += [F.count(f"_v{k}").alias(f"_n{k}"), F.min(f"_v{k}").alias(f"_min{k}"), F.max(f"_v{k}").alias(f"_max{k}"),
                     F.percentile_approx(f"_v{k}", edges, ACCURACY).alias(f"_e{k}")]
    first = (wide.groupBy(*group) if group else wide.groupBy(F.lit(0).alias("_all"))).agg(*aggregates, *sketches)
    keys = list(group) or ["_all"]

    def bracket(value: str, q: float, side: int) -> Column:
        k = number[value]
        edges = sorted({min(1.0, max(0.0, r + s * 2 / ACCURACY)) for v, r, _ in quantiles if v == value for s in (-1, 1)})
        edge = F.get(f"_e{k}", F.lit(edges.index(min(1.0, max(0.0, q + side * 2 / ACCURACY)))))
        # Few values are all kept; ranks of neighbours can't be told apart by parts of them.
        return F.when(F.col(f"_n{k}") <= 4 * ACCURACY, F.col(f"_min{k}" if side < 0 else f"_max{k}")).otherwise(edge)

    bounds = first.select(*keys, F.array(*[
        F.struct(F.lit(i).alias("i"), bracket(v, q, -1).alias("low"), bracket(v, q, 1).alias("high"), F.col(f"_n{number[v]}").alias("n"))
        for i, (v, q, _) in enumerate(quantiles)]).alias("_brackets"))
    rows = wide.select(*group, *([] if group else [F.lit(0).alias("_all")]), *[f"_v{k}" for k in range(len(values))])
    own = F.array(*[F.col(f"_v{number[v]}") for v, _, _ in quantiles])
    # Without groups there is one row of brackets.
    met = null_safe_join(rows, bounds if group else F.broadcast(bounds), keys).select(*keys, F.explode(F.zip_with(own, "_brackets", lambda v, b: F.struct(
        b["i"].alias("i"), b["n"].alias("size"), (v < b["low"]).alias("below"), (v > b["high"]).alias("above"), v.alias("v")))).alias("_e"))
    counts = met.filter("_e.v IS NOT NULL AND NOT _e.above").groupBy(
        *keys, F.col("_e.i").alias("_i"), F.col("_e.size").alias("_size"), F.when(~F.col("_e.below"), F.col("_e.v")).alias("_value")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys, "_i").orderBy(F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One exchange for the order, the picks and the join with the other aggregates.
    ranked = counts.repartition(*keys).withColumn("_upto", F.sum("_n").over(order))

    picks = []
    for i, (_, q, name) in enumerate(quantiles):
        position = F.lit(float(q)) * (F.col("_size") - 1)
        for suffix, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("_i") == i) & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            picks.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{name}_{suffix}"))
        picks.append(F.max(F.when(F.col("_i") == i, position)).alias(f"_{name}_pos"))
    picked = ranked.groupBy(*keys).agg(*picks).select(*keys, *[_interpolate(name).alias(name) for _, _, name in quantiles])
    made = {f"_{part}{k}" for k in range(len(values)) for part in ("n", "min", "max", "e")}
    plain = first.select(*[F.col(f"`{c}`") for c in first.columns if c not in made])
    return null_safe_join(plain, picked, keys, "left").drop("_all")


def _interpolate(name: str) -> Column:
    low, high, position = (F.col(f"_{name}_{part}") for part in ("lo", "hi", "pos"))
    return F.when(low == high, low).otherwise(
        (F.ceil(position) - position) * low + (position - F.floor(position)) * high)
