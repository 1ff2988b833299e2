"""Coupling of safety and emissions: aligned TTC and CO2 curves, lags, and the phase plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.operators.alignment import (
    aligned_rows, closed_spans, event_spans, first_episodes, peak_lag, resample, with_anchor,
)
from kerbline.operators.hexbin import hexbin
from kerbline.operators.intervals import slice_frames
from kerbline.operators.quantiles import summarise
from kerbline.operators.store import materialize
from kerbline.params import Params

WINDOW = (-5.0, 10.0)
VALUES = {"ttc": "TTC", "co2": "cpf_co2_rate_gps"}
# What counts as a severe episode, and the TTC range shown.
SEVERE_TTC, SEVERE_DURATION = 2.0, 0.8
TTC_RANGE = (0.0, 60.0)


def episode_rows(l1: DataFrame, conflicts: DataFrame, p: Params, max_episodes: int | None = None) -> DataFrame:
    """Frames around the lowest TTC of each conflict."""
    anchored = with_anchor(l1, event_spans(conflicts, open_bounds=True), p, fall_back_to_start=False)
    closed = anchored.fillna({"_from": 0, "_upto": 2**62})
    rows = aligned_rows(l1, closed, VALUES, WINDOW, p)
    return rows if max_episodes is None else first_episodes(rows, max_episodes)


def aligned_series(l1: DataFrame, conflicts: DataFrame, p: Params, max_episodes: int | None = None) -> DataFrame:
    """TTC and CO2 of each conflict on the common grid."""
    rows = episode_rows(l1, conflicts, p, max_episodes)
    events = conflicts.select("recordingId", "event_id")
    return resample(rows, events, list(VALUES), WINDOW, p)


def aligned_curve(l1: DataFrame, conflicts: DataFrame, p: Params, max_episodes: int | None = None) -> DataFrame:
    """Mean and outer deciles of TTC and CO2 at each grid offset, and the number of episodes."""
    series = materialize(aligned_series(l1, conflicts, p, max_episodes), "aligned")
    curve = summarise(
        series, ["offset"],
        [F.avg("ttc").alias("TTC_mean"), F.avg("co2").alias("CO2_mean"), F.count("*").alias("n_episodes")],
        [("ttc", 0.1, "TTC_p10"), ("ttc", 0.9, "TTC_p90"), ("co2", 0.1, "CO2_p10"), ("co2", 0.9, "CO2_p90")])
    return curve.withColumn("t", F.col("offset") / p.frame_rate).orderBy("offset")


def lags(l1: DataFrame, conflicts: DataFrame, p: Params) -> DataFrame:
    """Delay of the CO2 peak behind the lowest TTC, per conflict."""
    return peak_lag(episode_rows(l1, conflicts, p), "co2", p)


def lag_stats(l1: DataFrame, conflicts: DataFrame, p: Params) -> DataFrame:
    return summarise(
        materialize(lags(l1, conflicts, p), "lags"), [], [F.avg("lag").alias("mean")],
        [("lag", 0.5, "median"), ("lag", 0.1, "p10"), ("lag", 0.9, "p90")])


def _is_severe(conflicts: DataFrame):
    severe = F.lit(True)
    if "min_TTC_conf" in conflicts.columns:
        severe = severe & (F.col("min_TTC_conf") < SEVERE_TTC)
    if "conf_duration" in conflicts.columns:
        severe = severe & (F.col("conf_duration") >= SEVERE_DURATION)
    return severe


def phase_samples(l1: DataFrame, conflicts: DataFrame, p: Params, energy: str = "cpf_co2_rate_gps") -> DataFrame:
    """(TTC, emission rate) of every frame of every conflict episode."""
    spans = closed_spans(l1, event_spans(conflicts, open_bounds=True).drop("anchor"))
    frames = l1.select("recordingId", "trackId", "frame", "TTC", F.col(energy).alias("energy"))
    low, high = TTC_RANGE
    clipped = F.when(F.col("TTC").isNotNull(), F.least(F.greatest(F.col("TTC").cast("double"), F.lit(low)), F.lit(high)))
    return slice_frames(frames, spans, F.col("_from"), F.col("_upto"), p).select(
        "recordingId", "event_id", "frame", clipped.alias("TTC"), F.col("energy").cast("double").alias("energy"))


def severe_conflicts(conflicts: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` severe conflicts by recording and lowest TTC."""
    return conflicts.filter(_is_severe(conflicts)).orderBy("recordingId", "min_TTC_conf", "event_id").limit(n)


def severe_trajectories(l1: DataFrame, conflicts: DataFrame, p: Params, n: int = 5) -> DataFrame:
    return phase_samples(l1, severe_conflicts(conflicts, n), p)


def phase_density(l1: DataFrame, conflicts: DataFrame, p: Params, cells: int = 60) -> DataFrame:
    """Hexagonal density of the phase plane."""
    samples = materialize(phase_samples(l1, conflicts, p).select("TTC", "energy"), "phase")
    return hexbin(samples, "TTC", "energy", cells)
