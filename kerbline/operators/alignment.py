"""Aligning episodes on a common time axis, in whole frames relative to an anchor frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.operators.intervals import interval_bounds, slice_frames
from kerbline.params import Params

EVENT = ("recordingId", "event_id")
# Event columns that may already name the frame of the lowest TTC.
ANCHOR_COLUMNS = ("min_ttc_frame", "frame_min_ttc", "conf_min_ttc_frame", "ttc_min_frame")


def grid_bounds(window: tuple[float, float], p: Params) -> tuple[int, int]:
    low, high = (seconds * p.frame_rate for seconds in window)
    return math.ceil(low - 1e-9), math.floor(high + 1e-9)


def event_spans(events: DataFrame, open_bounds: bool) -> DataFrame:
    """Key, vehicle, first and last frame, and the anchor where the table names one.

    An event without a bound is left open on that side, or dropped.
    """
    start, end = interval_bounds(events.columns)
    start, end = (F.lit(None) if bound is None else bound for bound in (start, end))
    anchors = [F.col(c).cast("long") for c in ANCHOR_COLUMNS if c in events.columns]
    recording = "recordingId" if "recordingId" in events.columns else "rec_id"
    spans = events.select(
        F.col(recording).alias("recordingId"), "event_id", F.col("ego_id").cast("long").alias("ego_id"),
        start.cast("long").alias("_from"), end.cast("long").alias("_upto"),
        (F.coalesce(*anchors) if anchors else F.lit(None).cast("long")).alias("anchor"))
    return spans if open_bounds else spans.dropna(subset=["_from", "_upto"])


def with_anchor(l1: DataFrame, spans: DataFrame, p: Params, fall_back_to_start: bool) -> DataFrame:
    """Fill missing anchors with the first frame of the lowest TTC inside the event.

    Only events whose table names no anchor touch the frames. What is left without one starts at its
    first frame, or is dropped.
    """
    known = spans.filter("anchor IS NOT NULL")
    open_events = closed_spans(l1, spans.filter("anchor IS NULL").drop("anchor"))
    frames = l1.select("recordingId", "trackId", "frame", "TTC").filter("TTC IS NOT NULL")
    found = (
        slice_frames(frames, open_events, F.col("_from"), F.col("_upto"), p)
        .groupBy(*EVENT).agg(F.min_by("frame", F.struct("TTC", "frame")).alias("anchor"))
    )
    filled = open_events.join(found, list(EVENT), "left")
    if fall_back_to_start:
        filled = filled.withColumn("anchor", F.coalesce("anchor", "_from"))
    return known.unionByName(filled.select(*known.columns)).filter("anchor IS NOT NULL")


def closed_spans(l1: DataFrame, spans: DataFrame) -> DataFrame:
    """Give open sides the first and last frame of the vehicle's track."""
    half_open = spans.filter("_from IS NULL OR _upto IS NULL")
    tracks = l1.groupBy("recordingId", F.col("trackId").alias("ego_id")).agg(
        F.min("frame").alias("_first"), F.max("frame").alias("_last"))
    closed = half_open.join(tracks, ["recordingId", "ego_id"]).withColumns({
        "_from": F.coalesce("_from", "_first"), "_upto": F.coalesce("_upto", "_last")})
    return spans.filter("_from IS NOT NULL AND _upto IS NOT NULL").unionByName(closed.select(*spans.columns))


def aligned_rows(l1: DataFrame, anchored: DataFrame, values: dict[str, str], window: tuple[float, float],
                 p: Params) -> DataFrame:
    """Frames of each event inside the window around its anchor: key, ``offset``, values."""
    low, high = grid_bounds(window, p)
    frames = l1.select("recordingId", "trackId", "frame", *[F.col(c).alias(name) for name, c in values.items()])
    start = F.greatest(F.col("_from"), F.col("anchor") + low)
    end = F.least(F.col("_upto"), F.col("anchor") + high)
    rows = slice_frames(frames, anchored, start, end, p)
    return rows.select(*EVENT, (F.col("frame") - F.col("anchor")).alias("offset"),
                       *[F.col(name).cast("double").alias(name) for name in values])


def resample(rows: DataFrame, anchored: DataFrame, names: list[str], window: tuple[float, float],
             p: Params) -> DataFrame:
    """Every grid offset for every event that has rows; linear between samples, empty outside them.

    A single sample is held for one frame either way. Grid and samples share one shuffle by event,
    and an event's window holds no more rows than the grid.
    """
    low, high = grid_bounds(window, p)
    grid = anchored.select(
        *EVENT, F.explode(F.expr(f"sequence({low}L, {high}L)")).alias("offset"),
        *[F.lit(None).cast("double").alias(n) for n in names], F.lit(0).alias("_seen"))
    samples = rows.select(*EVENT, "offset", *names, F.lit(1).alias("_seen"))
    event = Window.partitionBy(*EVENT)
    merged = (
        samples.unionByName(grid).repartition(*EVENT)
        .groupBy(*EVENT, "offset").agg(*[F.max(n).alias(n) for n in names], F.max("_seen").alias("_seen"))
        .withColumn("_seen", F.max("_seen").over(event)).filter("_seen = 1")
    )
    helpers = {}
    for n in names:
        sample = F.when(F.col(n).isNotNull(), F.struct(F.col("offset").alias("at"), F.col(n).alias("value")))
        running = (Window.unboundedPreceding, Window.currentRow)
        latest = F.last(sample, ignorenulls=True)
        helpers[f"_{n}_back"] = latest.over(event.orderBy("offset").rowsBetween(*running))
        helpers[f"_{n}_ahead"] = latest.over(event.orderBy(F.desc("offset")).rowsBetween(*running))
        helpers[f"_{n}_count"] = F.count(n).over(event)
    return merged.withColumns(helpers).select(*EVENT, "offset", *[_interpolated(n).alias(n) for n in names])


def _interpolated(name: str) -> Column:
    back, ahead = F.col(f"_{name}_back"), F.col(f"_{name}_ahead")
    only = F.coalesce(back, ahead)
    slope = (ahead["value"] - back["value"]) / (ahead["at"] - back["at"])
    return (
        F.when(F.col(name).isNotNull(), F.col(name))
        .when(F.col(f"_{name}_count") == 1,
              F.when(F.abs(F.col("offset") - only["at"]) <= 1, only["value"]))
        .when(back.isNotNull() & ahead.isNotNull(), back["value"] + slope * (F.col("offset") - back["at"]))
    )


def peak_lag(rows: DataFrame, value: str, p: Params) -> DataFrame:
    """Seconds from the anchor to the first maximum of ``value``, per event."""
    peak = F.min_by("offset", F.struct((-F.col(value)).alias("low"), "offset"))
    return rows.filter(F.col(value).isNotNull()).groupBy(*EVENT).agg((peak / p.frame_rate).alias("lag"))


def first_episodes(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of the first ``limit`` episodes that have any, in (recording, event) order."""
    chosen = rows.select(*EVENT).distinct().orderBy(*EVENT).limit(limit)
    return rows.join(chosen, list(EVENT), "left_semi")
