"""Frame table (L1): raw tracks to one row per recording, vehicle and frame with derived quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kerbline.functions.emissions import add_fuel_model, add_specific_power
from kerbline.functions.kinematics import (
    add_image_coordinates, along_direction, along_road, encode_class, global_track_id,
)
from kerbline.functions.safety import add_interaction, add_safety
from kerbline.operators.smoothing import with_smoothed
from kerbline.operators.store import materialize
from kerbline.operators.tracks import HALO, PIECE, TRACK, WORKING, index_and_halo, lane_changed, track_pieces
from kerbline.params import Params
from kerbline.schemas import L1, NEIGHBOUR_IDS, conform
from kerbline.sources.raw import RawTables

#: The columns of L1 that events and their costs rest on, and the smoothed ones that these are made of.
EVENT_COLUMNS = ("recordingId", "trackId", "frame", "time", "dt", "s_long", "laneId_raw", "veh_class", "v_long_smooth", "a_long_smooth",
                 "TTC", "cpf_co2_rate_gps", "cpf_fuel_rate_lps", "vsp_co2_rate", "vsp_nox_rate")
_BEHIND_EVENTS = (*EVENT_COLUMNS[:10], *WORKING, "precedingId", "width", "ttc_raw", "dist_headway_raw")
LEADER = ("leader_s_long", "leader_v_long", "leader_a_long", "leader_width")
_OPTIONAL = {"laneId": 0, "dhw": None, "thw": None, "ttc": None, **{name: 0 for name in NEIGHBOUR_IDS}}


def frame_columns(tracks: DataFrame) -> DataFrame:
    """The raw columns that are used, under their final names."""
    missing = {c: F.lit(v) for c, v in _OPTIONAL.items() if c not in tracks.columns}
    return tracks.withColumns(missing).select(
        "recordingId", F.col("id").alias("trackId"), "frame",
        F.col("x").alias("x_raw"), F.col("y").alias("y_raw"),
        F.col("width").alias("_frame_width"), F.col("height").alias("_frame_height"),
        "xVelocity", "xAcceleration",
        F.col("laneId").cast("long").alias("laneId_raw"),
        *[F.col(c).cast("long").alias(c) for c in NEIGHBOUR_IDS],
        F.col("dhw").cast("float").alias("dist_headway_raw"),
        F.col("thw").cast("float").alias("time_headway_raw"),
        F.col("ttc").cast("float").alias("ttc_raw"),
    )


def track_dimension(tracks_meta: DataFrame) -> DataFrame:
    return tracks_meta.select(
        "recordingId", F.col("id").alias("trackId"), encode_class(F.col("class")).alias("veh_class"),
        F.col("drivingDirection").cast("byte").alias("drivingDirection"),
        F.col("width").alias("_meta_width"), F.col("height").alias("_meta_height"),
    )


_EXTENTS = {
    "_x0": F.min, "_x1": F.max, "_y0": F.min, "_y1": F.max, "_xw": F.max, "_yh": F.max,
}


def track_table(frames: DataFrame, meta: DataFrame, p: Params) -> DataFrame:
    """Per (track, piece): row counts, metadata and bounding box, from one narrow pass over the frames.

    Written out, since its size then decides how it and its recording totals are joined.
    """
    bounds = frames.withColumns({
        "_x0": F.col("x_raw"), "_x1": F.col("x_raw"), "_y0": F.col("y_raw"), "_y1": F.col("y_raw"),
        "_xw": F.col("x_raw") + F.col("_frame_width"), "_yh": F.col("y_raw") + F.col("_frame_height"),
    })
    extra = [combine(name).alias(name) for name, combine in _EXTENTS.items()]
    pieces = track_pieces(bounds, p, extra).join(meta, list(TRACK), "left")
    if p.strict_metadata:
        miss = F.raise_error(F.lit("frame rows without vehicle metadata"))
        pieces = pieces.withColumn("drivingDirection", F.coalesce("drivingDirection", miss.cast("byte")))
    return materialize(pieces, "pieces")


def recording_table(raw: RawTables, pieces: DataFrame, p: Params) -> DataFrame:
    """Per recording: bounding box over the vehicles' own sizes, and frame rate."""
    extents = pieces.groupBy("recordingId").agg(
        F.min("_x0").alias("min_x"),
        F.max(F.coalesce(F.col("_x1") + F.col("_meta_width"), "_xw")).alias("max_x"),
        F.min("_y0").alias("min_y"),
        F.max(F.coalesce(F.col("_y1") + F.col("_meta_height"), "_yh")).alias("max_y"),
    )
    rate = F.col("frameRate") if "frameRate" in raw.recordings.columns else F.lit(None)
    rates = raw.recordings.select(F.col("id").cast("int").alias("recordingId"), rate.cast("double").alias("frameRate"))
    return extents.join(rates, "recordingId", "left").withColumn(
        "frameRate", F.coalesce("frameRate", F.lit(p.frame_rate)))


def piece_table(raw: RawTables, p: Params) -> DataFrame:
    return track_table(frame_columns(raw.tracks), track_dimension(raw.tracks_meta), p)


def keyed_frames(raw: RawTables, p: Params, pieces: DataFrame | None = None) -> DataFrame:
    """Frames with metadata, unified coordinates, and row order; borders of pieces are duplicated as halo."""
    frames = frame_columns(raw.tracks)
    pieces = piece_table(raw, p) if pieces is None else pieces
    reach = p.smooth_window - 1
    rows = index_and_halo(frames, pieces.drop(*_EXTENTS), p, before=reach, after=reach)
    # Written first, so that its size is known when the frames are joined.
    recordings = materialize(recording_table(raw, pieces, p), "recordings")
    return _unify(rows.join(recordings, "recordingId", "left"))


def _unify(rows: DataFrame) -> DataFrame:
    direction = F.coalesce(F.col("drivingDirection"), F.lit(0))
    return (
        rows.withColumns({
            "width": F.coalesce("_meta_width", "_frame_width"),
            "height": F.coalesce("_meta_height", "_frame_height"),
            "global_track_id": global_track_id(F.col("recordingId"), F.col("trackId")),
            "time": F.col("frame") / F.col("frameRate"),
            "dt": (1 / F.col("frameRate")).cast("float"),
            "frame_s": 1 / F.col("frameRate"),
        })
        .withColumns({
            "s_long": along_road(F.col("x_raw"), F.col("width"), direction, F.col("max_x")),
            "d_lat": F.col("y_raw") + F.col("height") / 2,
            "v_long_raw": along_direction(F.col("xVelocity"), direction),
            "a_long_raw": along_direction(F.col("xAcceleration"), direction),
        })
        .drop("_meta_width", "_frame_width", "_meta_height", "_frame_height", "xVelocity", "xAcceleration",
              "frameRate")
    )


def smoothed_frames(raw: RawTables, p: Params, pieces: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Frames with smoothed motion, written as a table: vehicles and their leaders are both read from it.

    ``columns`` names those that are needed, if not all.
    """
    rows = with_smoothed(keyed_frames(raw, p, pieces), "v_long_raw", {"v_long_smooth": 0, "a_long_smooth": 1}, p)
    rows = rows.withColumn("lane_changed", lane_changed()).filter(~F.col(HALO)).drop(HALO, PIECE)
    return materialize(rows.select(*columns) if columns else rows, "smoothed")


def with_leader(rows: DataFrame) -> DataFrame:
    """Bring the preceding vehicle's state in the same frame.

    Vehicles without a leader get a key of their own that nothing matches: sharing one key (0), they
    would all meet in the same partition.
    """
    leader_key = F.when(F.col("precedingId") > 0, F.col("precedingId")).otherwise(-1 - F.col("trackId"))
    leaders = rows.select(
        "recordingId", "frame", F.col("trackId").alias("_leader"),
        F.col("s_long").alias("leader_s_long"), F.col("v_long_smooth").alias("leader_v_long"),
        F.col("a_long_smooth").alias("leader_a_long"), F.col("width").alias("leader_width"),
    )
    return rows.withColumn("_leader", leader_key).join(
        leaders, ["recordingId", "frame", "_leader"], "left").drop("_leader")


def _rated(smoothed: DataFrame, p: Params) -> DataFrame:
    """Safety against the leader, and emissions."""
    rows = add_safety(add_interaction(with_leader(smoothed)), p)
    return add_specific_power(add_fuel_model(rows), p)


def working_frames(raw: RawTables, p: Params, smoothed: DataFrame | None = None) -> DataFrame:
    """L1 with its working columns (row order, lane changes, frame length), from which the event stage continues."""
    rows = _rated(smoothed_frames(raw, p) if smoothed is None else smoothed, p)
    return conform(add_image_coordinates(rows, p), L1, WORKING)


def event_frames(raw: RawTables, p: Params, pieces: DataFrame | None = None, smoothed: DataFrame | None = None) -> DataFrame:
    """The columns of L1 that events and their costs rest on, with its working columns: all rows, a third of the columns.

    Most of the time of a large L1 goes into carrying, sorting and writing columns; events need few of them.
    """
    rows = _rated(smoothed_frames(raw, p, pieces, _BEHIND_EVENTS) if smoothed is None else smoothed, p)
    return conform(rows, StructType([field for field in L1 if field.name in EVENT_COLUMNS]), WORKING)


def master_frames(raw: RawTables, p: Params, smoothed: DataFrame | None = None) -> DataFrame:
    """L1 in its published form."""
    return working_frames(raw, p, smoothed).drop(*WORKING)
