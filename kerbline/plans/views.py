"""Excerpts of the frame table: a moment, a vehicle, an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.kinematics import recode_class
from kerbline.operators.intervals import slice_frames
from kerbline.params import Params


def load_master(l1: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Selected columns, class names of older tables turned into codes."""
    picked = l1 if columns is None else l1.select(*columns)
    if "veh_class" in picked.columns:
        picked = picked.withColumn("veh_class", recode_class(F.col("veh_class")))
    return picked


def frame_snapshot(l1: DataFrame, frame: int, recording: int | None = None, colour: str = "TTC") -> DataFrame:
    """All vehicles of one frame with position and the column that colours them."""
    rows = l1.filter(F.col("frame") == frame)
    if recording is not None:
        rows = rows.filter(F.col("recordingId") == recording)
    return rows.select("recordingId", "frame", "trackId", "x_img", "y_img", F.col(colour).alias("colour"))


def track_profile(l1: DataFrame, recording: int, track: int) -> DataFrame:
    rows = l1.filter((F.col("recordingId") == recording) & (F.col("trackId") == track))
    return rows.select("frame", "s_long", "v_long_smooth").orderBy("frame")


def event_trace(l1: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """Speed, acceleration and CO2 over the time since each event's start; conflict cores are marked."""
    core = [F.col(c).alias(f"_{c}") for c in ("conf_start_frame", "conf_end_frame") if c in events.columns]
    spans = events.select(
        "recordingId", "event_id", F.col("ego_id").cast("long").alias("ego_id"),
        "start_frame", "end_frame", "start_time", *core)
    frames = l1.select("recordingId", "trackId", "frame", "time", "v_long_smooth", "a_long_smooth", "cpf_co2_rate_gps")
    rows = slice_frames(frames, spans, F.col("start_frame"), F.col("end_frame"), p)
    since = F.coalesce(F.col("time") - F.col("start_time"), (F.col("frame") - F.col("start_frame")) / p.frame_rate)
    inside = F.col("frame").between(F.col("_conf_start_frame"), F.col("_conf_end_frame")) if core else F.lit(False)
    return rows.select("recordingId", "event_id", "frame", since.alias("t"), "v_long_smooth", "a_long_smooth",
                       "cpf_co2_rate_gps", inside.alias("in_core"))
