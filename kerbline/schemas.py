"""Explicit schemas of sources and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INT, LONG, BYTE = T.IntegerType(), T.LongType(), T.ByteType()
FLOAT, DOUBLE, STRING = T.FloatType(), T.DoubleType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RECORDING_META = _struct(
    ("id", INT), ("frameRate", DOUBLE), ("locationId", INT), ("speedLimit", DOUBLE),
    ("month", STRING), ("weekDay", STRING), ("startTime", STRING), ("duration", DOUBLE),
    ("totalDrivenDistance", DOUBLE), ("totalDrivenTime", DOUBLE), ("numVehicles", INT),
    ("numCars", INT), ("numTrucks", INT), ("upperLaneMarkings", STRING), ("lowerLaneMarkings", STRING),
)

TRACKS_META = _struct(
    ("id", LONG), ("width", DOUBLE), ("height", DOUBLE), ("initialFrame", LONG), ("finalFrame", LONG),
    ("numFrames", LONG), ("class", STRING), ("drivingDirection", INT), ("traveledDistance", DOUBLE),
    ("minXVelocity", DOUBLE), ("maxXVelocity", DOUBLE), ("meanXVelocity", DOUBLE), ("minDHW", DOUBLE),
    ("minTHW", DOUBLE), ("minTTC", DOUBLE), ("numLaneChanges", INT),
)

NEIGHBOUR_IDS = (
    "precedingId", "followingId",
    "leftPrecedingId", "leftAlongsideId", "leftFollowingId",
    "rightPrecedingId", "rightAlongsideId", "rightFollowingId",
)

TRACKS = _struct(
    ("frame", LONG), ("id", LONG), ("x", DOUBLE), ("y", DOUBLE), ("width", DOUBLE), ("height", DOUBLE),
    ("xVelocity", DOUBLE), ("yVelocity", DOUBLE), ("xAcceleration", DOUBLE), ("yAcceleration", DOUBLE),
    ("frontSightDistance", DOUBLE), ("backSightDistance", DOUBLE), ("dhw", DOUBLE), ("thw", DOUBLE),
    ("ttc", DOUBLE), ("precedingXVelocity", DOUBLE),
    *((name, LONG) for name in NEIGHBOUR_IDS),
    ("laneId", LONG),
)

# One row per recording, vehicle and frame; the order of the columns is part of the format.
L1 = _struct(
    ("recordingId", INT), ("frame", LONG), ("trackId", LONG), ("global_track_id", LONG), ("time", DOUBLE),
    ("x_raw", DOUBLE), ("y_raw", DOUBLE), ("width", DOUBLE), ("height", DOUBLE), ("laneId_raw", LONG),
    ("x_img", FLOAT), ("y_img", FLOAT),
    ("drivingDirection", BYTE), ("veh_class", BYTE), ("s_long", DOUBLE), ("d_lat", DOUBLE),
    ("v_long_raw", DOUBLE), ("a_long_raw", DOUBLE), ("v_long_smooth", FLOAT), ("a_long_smooth", FLOAT),
    *((name, LONG) for name in NEIGHBOUR_IDS),
    ("leader_s_long", DOUBLE), ("leader_v_long", FLOAT), ("leader_a_long", FLOAT),
    ("dist_headway_raw", FLOAT), ("time_headway_raw", FLOAT), ("ttc_raw", FLOAT),
    ("dist_headway", DOUBLE), ("rel_velocity", FLOAT), ("time_headway", FLOAT),
    ("TTC", FLOAT), ("DRAC", FLOAT), ("risk_level", BYTE),
    ("vehicle_type", STRING), ("v_kmh", FLOAT), ("a_kmhps", FLOAT), ("cpf_power_kw", FLOAT),
    ("cpf_fuel_rate_lps", FLOAT), ("cpf_co2_rate_gps", FLOAT), ("vsp_value", FLOAT),
    ("vsp_co2_rate", FLOAT), ("vsp_nox_rate", FLOAT), ("dt", FLOAT),
)

_ENERGY = (("E_cpf_CO2", DOUBLE), ("E_cpf_fuel", DOUBLE), ("E_vsp_CO2", DOUBLE), ("E_vsp_NOx", DOUBLE))

CONFLICTS = _struct(
    ("event_id", LONG), ("recordingId", INT), ("ego_id", INT), ("start_frame", INT), ("end_frame", INT),
    ("start_time", DOUBLE), ("end_time", DOUBLE), ("duration", DOUBLE), ("conf_start_frame", INT),
    ("conf_end_frame", INT), ("conf_duration", DOUBLE), ("min_TTC", DOUBLE), ("min_TTC_conf", DOUBLE),
    ("veh_class", BYTE), ("num_lane_changes", INT), *_ENERGY,
)

BASELINES = _struct(
    ("event_id", LONG), ("recordingId", INT), ("ego_id", INT), ("start_frame", INT), ("end_frame", INT),
    ("start_time", DOUBLE), ("end_time", DOUBLE), ("duration", DOUBLE), ("veh_class", BYTE),
    ("min_TTC", DOUBLE), ("mean_TTC", DOUBLE), ("num_lane_changes", INT), *_ENERGY,
)


def conform(df: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project to the schema's columns, order and types, keeping ``extra`` columns at the end."""
    casts = [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields]
    return df.selectExpr(*casts, *extra)
