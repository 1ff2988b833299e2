"""Event tables (L2): conflict episodes and baseline windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.rates import frame_seconds, integral, reaches, total_seconds
from kerbline.operators.intervals import hop_windows, runs, slice_frames
from kerbline.operators.ordered import number_rows
from kerbline.operators.store import materialize
from kerbline.operators.tracks import TRACK, with_working_columns
from kerbline.params import Params
from kerbline.schemas import BASELINES, CONFLICTS, conform

ENERGY = {
    "E_cpf_CO2": "cpf_co2_rate_gps", "E_cpf_fuel": "cpf_fuel_rate_lps",
    "E_vsp_CO2": "vsp_co2_rate", "E_vsp_NOx": "vsp_nox_rate",
}
_USED = ("recordingId", "trackId", "frame", "TTC", "row_idx", "n_rows", "lane_changed")
# Columns an L1 table may lack, with the type of the missing value.
_MAY_LACK = {"time": "double", "a_long_smooth": "float", "laneId_raw": "long", "veh_class": "byte", "dt": "float",
             **dict.fromkeys(ENERGY.values(), "float")}
THRESHOLD = "ttc_threshold"


def _event_rows(l1: DataFrame, p: Params) -> DataFrame:
    """The L1 columns that events use, null where the table lacks them, and the length of each frame."""
    rows = with_working_columns(l1, p)
    lacking = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in _MAY_LACK.items()]
    return rows.select(*_USED, *lacking, frame_seconds(rows.columns, p.frame_rate).alias("_dt"))


def _window_measures(l1: DataFrame, p: Params) -> list[Column]:
    """Aggregates that conflict and baseline windows share. The energy of a rate the table lacks is unknown."""
    changes = F.sum(F.col("lane_changed").cast("int")) - F.min_by(F.col("lane_changed").cast("int"), "frame")
    return [
        F.min_by("time", "frame").alias("start_time"), F.max_by("time", "frame").alias("end_time"),
        total_seconds(F.sum("_dt"), F.count("dt"), F.min("frame"), F.max("frame"), p.frame_rate).alias("duration"),
        F.min("TTC").alias("min_TTC"), F.min_by("veh_class", "frame").alias("veh_class"), changes.alias("num_lane_changes"),
        *[(integral(F.col(rate), F.col("_dt")) if rate in l1.columns else F.lit(None).cast("double")).alias(name)
          for name, rate in ENERGY.items()],
    ]


def conflict_runs(l1: DataFrame, p: Params, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Runs of low TTC: the cores of conflicts, before any minimum length.

    Several thresholds are served in one pass and told apart by ``ttc_threshold``.
    """
    levels = [float(t) for t in (thresholds or [p.ttc_conflict])]
    rows = with_working_columns(l1, p)
    dt = F.col("dt") if "dt" in rows.columns else F.lit(None)
    rows = rows.select(*TRACK, "frame", "TTC", "row_idx", dt.isNotNull().cast("int").alias("_known"),
                       frame_seconds(rows.columns, p.frame_rate).alias("_dt"))
    low = rows.filter(F.col("TTC") < max(levels))
    reached = F.array_compact(F.array(*[F.when(F.col("TTC") < t, F.lit(i)) for i, t in enumerate(levels)]))
    low = low.withColumn("_level", F.explode(reached))
    measures = {
        "_length": (F.sum("_dt"), F.sum("_length")), "_known": (F.sum("_known"), F.sum("_known")),
        "min_TTC_conf": (F.min("TTC"), F.min("min_TTC_conf")),
    }
    # Grouped by the threshold's number: a floating-point key would be normalised in some operators
    # and not in others, which costs extra shuffles.
    found = runs(low, measures, p, also_by=["_level"])
    found = found.withColumn("conf_duration", total_seconds(
        F.col("_length"), F.col("_known"), F.col("run_start"), F.col("run_end"), p.frame_rate)).drop("_length", "_known")
    return found.withColumn(THRESHOLD, F.get(F.array(*[F.lit(t) for t in levels]), F.col("_level"))).drop("_level")


def conflict_windows(l1: DataFrame, p: Params, thresholds: Sequence[float] | None = None,
                     min_duration: float | None = None) -> DataFrame:
    """Conflict episodes with their context window, not yet numbered."""
    shortest = p.min_conflict_duration if min_duration is None else min_duration
    long_enough = reaches(F.col("conf_duration"), shortest)
    if p.min_conflict_frames is not None:
        long_enough = F.col("run_rows") >= p.min_conflict_frames
    # Written first, so that their size is known when the frames are sliced: for few cores the frames need no shuffle.
    cores = materialize(conflict_runs(l1, p, thresholds).filter(long_enough).select(
        "recordingId", F.col("trackId").alias("ego_id"), THRESHOLD,
        F.col("run_start").alias("conf_start_frame"), F.col("run_end").alias("conf_end_frame"),
        "conf_duration", F.col("min_TTC_conf").cast("double"),
    ), "cores")
    before, after = p.frames(p.pre_event_time), p.frames(p.post_event_time)
    rows = slice_frames(
        _event_rows(l1, p), cores, F.col("conf_start_frame") - before, F.col("conf_end_frame") + after, p)
    key = ["recordingId", "ego_id", THRESHOLD, "conf_start_frame", "conf_end_frame"]
    # The window is clamped to the track; a slice that holds the track's first (last) row was clamped there.
    start = F.when(F.min("row_idx") == 0, F.min("frame")).otherwise(F.col("conf_start_frame") - before)
    end = F.when(F.max("row_idx") == F.max("n_rows") - 1, F.max("frame")).otherwise(
        F.col("conf_end_frame") + after)
    return rows.groupBy(*key).agg(
        F.max("conf_duration").alias("conf_duration"), F.max("min_TTC_conf").alias("min_TTC_conf"),
        start.alias("start_frame"), end.alias("end_frame"), *_window_measures(l1, p),
        F.min_by("frame", F.struct("TTC", "frame")).alias("min_ttc_frame"),
    ).transform(_with_times, p)


def _with_times(windows: DataFrame, p: Params) -> DataFrame:
    """Times that the frames don't give follow from the frame numbers at the default rate."""
    rate = F.lit(float(p.frame_rate))
    return windows.withColumns({"start_time": F.coalesce("start_time", F.col("start_frame") / rate),
                                "end_time": F.coalesce("end_time", F.col("end_frame") / rate)})


def baseline_windows(l1: DataFrame, p: Params) -> DataFrame:
    """Calm, lane-keeping windows of fixed length, not yet numbered.

    A tense row rules out each window that it belongs to. It is left out before the rows are copied into windows, and a window
    that lacks a row is not calm. A row whose values are unknown rules out none.
    """
    size, step = p.frames(p.baseline_window_time), p.frames(p.baseline_step_time)
    tense = F.coalesce(F.col("TTC") <= p.ttc_baseline, F.lit(False)) | F.coalesce(
        F.abs("a_long_smooth") >= p.accel_baseline, F.lit(False))
    windows = hop_windows(_event_rows(l1, p).filter(~tense), size, step).groupBy(
        "recordingId", F.col("trackId").alias("ego_id"), "window_no").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), *_window_measures(l1, p),
        F.avg(F.col("TTC").cast("double")).alias("mean_TTC"), F.count("*").alias("_rows"),
        F.min("laneId_raw").alias("_lane_low"), F.max("laneId_raw").alias("_lane_high"),
    )
    one_lane = F.coalesce(F.col("_lane_low") == F.col("_lane_high"), F.lit(True))
    return windows.filter((F.col("_rows") == size) & one_lane).drop("_rows", "_lane_low", "_lane_high", "window_no").transform(_with_times, p)


def _numbered(windows: DataFrame, label: str, order: Sequence[str], p: Params) -> DataFrame:
    """Number events per recording in (track, start) order; they are written first, being needed often."""
    stored = materialize(windows, label)
    return number_rows(stored, ["recordingId"], order, "event_id", stored=True)


def conflict_events(l1: DataFrame, p: Params) -> DataFrame:
    numbered = _numbered(conflict_windows(l1, p), "conflicts", ["ego_id", "conf_start_frame"], p)
    return conform(numbered, CONFLICTS, ("min_ttc_frame",))


def baseline_events(l1: DataFrame, p: Params) -> DataFrame:
    return conform(_numbered(baseline_windows(l1, p), "baselines", ["ego_id", "start_frame"], p), BASELINES)


def build_events(l1: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Both event tables of an L1 table."""
    return conflict_events(l1, p), baseline_events(l1, p)
