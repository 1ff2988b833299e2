"""Nearest-neighbour matching of events to baselines of the same recording and vehicle class."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.operators.joins import null_safe_join
from kerbline.operators.ordered import number_rows
from kerbline.operators.store import materialize
from kerbline.params import Params

GROUP = ("recordingId", "veh_class")
PROBE = ("recordingId", "l2_event_id")
#: Children of a node.
FANOUT = 8
#: Bits of each coordinate in the order of the leaves.
BITS = 16
BOX = ("d_low", "d_high", "v_low", "v_high", "rep_d", "rep_v")


@dataclass(frozen=True)
class BoxTree:
    """Candidates in order of a space-filling curve, cut into leaves of FANOUT, these into nodes of FANOUT, and so on.

    ``leaves`` are the candidates with their ``parent``; ``levels[0]`` are the nodes above them, the last level has FANOUT nodes
    or fewer a group. A node has the box of its candidates and one of them as representative. Whatever the durations and speeds, a
    group of n candidates has as many levels as n has digits to the base FANOUT.
    """

    leaves: DataFrame
    levels: list[DataFrame]


def _spread(code: Column) -> Column:
    """The bits of a number of BITS bits, each followed by a 0."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        code = code.bitwiseOR(F.shiftleft(code, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return code


def build_tree(candidates: DataFrame) -> BoxTree:
    """``candidates`` hold GROUP, cand_duration, cand_speed and base_id, without nulls and without equal points."""
    extent = candidates.groupBy(*GROUP).agg(
        F.min("cand_duration").alias("_d0"), F.max("cand_duration").alias("_d1"),
        F.min("cand_speed").alias("_v0"), F.max("cand_speed").alias("_v1"))

    def code(value: str, low: str, high: str) -> Column:
        share = F.when(F.col(high) > F.col(low), (F.col(value) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.0)
        return _spread((share * ((1 << BITS) - 1)).cast("long"))

    coded = null_safe_join(candidates, extent, GROUP).withColumn(
        "_code", code("cand_duration", "_d0", "_d1").bitwiseOR(F.shiftleft(code("cand_speed", "_v0", "_v1"), 1)))
    numbered = number_rows(coded.drop("_d0", "_d1", "_v0", "_v1"), GROUP, ("_code", "cand_duration", "cand_speed"), "_n")
    leaves = materialize(numbered.select(
        *GROUP, F.floor((F.col("_n") - 1) / FANOUT).alias("parent"), "cand_duration", "cand_speed", "base_id"), "match-leaves")
    entry = F.struct(F.col("rep_d").alias("d"), F.col("rep_v").alias("v"))

    def above(below: DataFrame) -> DataFrame:
        boxes = below.groupBy(*GROUP, F.col("parent").alias("node")).agg(
            F.min("d_low").alias("d_low"), F.max("d_high").alias("d_high"), F.min("v_low").alias("v_low"), F.max("v_high").alias("v_high"),
            F.min(entry).alias("rep"))
        return boxes.select(*GROUP, "node", F.floor(F.col("node") / FANOUT).alias("parent"), *BOX[:4],
                            F.col("rep.d").alias("rep_d"), F.col("rep.v").alias("rep_v"))

    d, v = F.col("cand_duration"), F.col("cand_speed")
    levels = [materialize(above(leaves.select(*GROUP, "parent", *[c.alias(name) for c, name in zip((d, d, v, v, d, v), BOX)])), "match-nodes")]
    nodes = 1 + (leaves.agg(F.max("parent")).first()[0] or 0)
    while nodes > FANOUT:
        levels.append(above(levels[-1]))
        nodes = -(-nodes // FANOUT)
    return BoxTree(leaves, levels)


def _cost(duration: Column, speed: Column, p: Params) -> Column:
    return (((F.col("probe_duration") - duration) / p.match_duration_scale) ** 2
            + ((F.col("probe_speed") - speed) / p.match_speed_scale) ** 2)


def _nearest_in(value: str, low: str, high: str) -> Column:
    return F.least(F.greatest(F.col(value), F.col(low)), F.col(high))


def descend(probes: DataFrame, tree: BoxTree, p: Params) -> Iterator[DataFrame]:
    """The nodes that may hold a probe's nearest candidate, level by level from the top, at last the candidates themselves.

    A node is left out if its box is outside the duration band, or farther than a candidate that another node of the level is sure
    to hold: its representative if that one is in the band, or any if the whole box is.
    """
    band = p.match_band
    front = probes.select(*GROUP, "l2_event_id", "probe_duration", "probe_speed")
    keys = list(GROUP)
    for level in reversed(tree.levels):
        met = front.join(level, keys)
        in_band = (F.col("d_low") - F.col("probe_duration") <= band) & (F.col("probe_duration") - F.col("d_high") <= band)
        met = met.filter(in_band)
        near = _cost(_nearest_in("probe_duration", "d_low", "d_high"), _nearest_in("probe_speed", "v_low", "v_high"), p)
        seen = F.when(F.abs(F.col("rep_d") - F.col("probe_duration")) <= band, _cost(F.col("rep_d"), F.col("rep_v"), p))
        whole = (F.abs(F.col("d_low") - F.col("probe_duration")) <= band) & (F.abs(F.col("d_high") - F.col("probe_duration")) <= band)
        far = F.when(whole, F.greatest(_cost(F.col("d_low"), F.col("v_low"), p), _cost(F.col("d_low"), F.col("v_high"), p),
                                       _cost(F.col("d_high"), F.col("v_low"), p), _cost(F.col("d_high"), F.col("v_high"), p)))
        bounded = met.select(*GROUP, "l2_event_id", "probe_duration", "probe_speed", F.col("node").alias("parent"),
                             near.alias("_near"), F.least(seen, far).alias("_sure"))
        yield bounded
        # A probe has FANOUT nodes for each one that was kept above.
        sure = F.min("_sure").over(Window.partitionBy(*PROBE, "veh_class"))
        front = bounded.withColumn("_least", sure).filter("_least IS NULL OR _near <= _least").drop("_near", "_sure", "_least")
        keys = [*GROUP, "parent"]
    yield front.join(tree.leaves, keys).filter(F.abs(F.col("cand_duration") - F.col("probe_duration")) <= band)


def nearest_by_speed(probes: DataFrame, candidates: DataFrame, p: Params) -> DataFrame:
    """For each probe the candidate minimising ((d duration)/s1)^2 + ((d speed)/s2)^2 within the band.

    Probes hold (recordingId, veh_class, l2_event_id, probe_duration, probe_speed), candidates
    (recordingId, veh_class, base_id, cand_duration, cand_speed). Returns (recordingId, l2_event_id,
    base_id); ties go to the smallest base_id, and probes without a candidate are absent.

    Comparing every probe with every candidate of its group would be quadratic in a large recording, and so would be a
    comparison per different duration. Candidates are put into a tree of boxes; probes go down the tree together, one join
    a level, each with the few nodes that its nearest candidate may be in.
    """
    best = candidates.dropna().groupBy(*GROUP, "cand_duration", "cand_speed").agg(F.min("base_id").alias("base_id"))
    usable = probes.filter("veh_class IS NOT NULL AND probe_duration IS NOT NULL AND probe_speed IS NOT NULL")
    *_, reached = descend(usable, build_tree(best), p)
    found = F.struct(_cost(F.col("cand_duration"), F.col("cand_speed"), p).alias("cost"), F.col("base_id"))
    return reached.groupBy(*PROBE).agg(F.min(found).alias("_best")).select(*PROBE, "_best.base_id")
