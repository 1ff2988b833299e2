"""Trajectories derived from a table of user activity (``events``).

Each user becomes a vehicle and each of its events a frame, in time order. This gives every operator
an input that grows with the given tables and that SQL can derive the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.operators.ordered import number_rows
from kerbline.operators.store import materialize
from kerbline.params import Params
from kerbline.sources.raw import RawTables

# Users of a block share four recordings, so that recordings grow in number with the users.
BLOCK, PER_BLOCK = 128, 4
ACTIVITY_PARAMS = Params(frame_rate=1.0, min_conflict_duration=0.4, consecutive_frames=True)


def activity_frames(events: DataFrame, p: Params = ACTIVITY_PARAMS) -> DataFrame:
    """Number each user's events in time order, whatever share of the events one user holds."""
    used = events.select("user_id", "ts", "event_id", "event_type", "value")
    return number_rows(used, ["user_id"], ["ts", "event_id"], "frame", stored=True)


def activity_tables(events: DataFrame, p: Params = ACTIVITY_PARAMS) -> RawTables:
    largest = events.agg(F.max("user_id")).first()[0] or 0
    user = F.col("user_id")
    calm = user % 3 == 0
    forward = F.floor(user / 4) % 2 == 1
    truck = user % 5 == 0
    value = F.col("value")
    speed = F.when(calm, 25 + value / (F.abs(value) + 50)).otherwise(20 + 30 * value / (F.abs(value) + 100))
    alone = calm | (user + 8 > largest) | (F.floor((user + 8) / BLOCK) > F.floor(user / BLOCK))
    recording = (user % PER_BLOCK + 1 + PER_BLOCK * F.floor(user / BLOCK)).cast("int")
    width = F.when(truck, F.lit(12.0)).otherwise(F.lit(4.5))
    place = (1000 + 25 * F.floor(user / 8) + (F.col("event_id") * 7) % 11).cast("double")
    lane = F.when(~calm & (F.col("event_type") == "signup"), F.lit(3)).otherwise(F.lit(2)).cast("long")
    vehicle = [
        recording.alias("recordingId"), (user + 1).cast("long").alias("id"),
        width.alias("width"), F.lit(2.0).alias("height"),
    ]
    direction = F.when(forward, F.lit(2)).otherwise(F.lit(1))
    numbered = activity_frames(events, p)
    tracks = numbered.select(
        *vehicle, "frame",
        F.when(forward, place - width / 2).otherwise(3000 - place - width / 2).alias("x"),
        (2.0 + 4 * lane).alias("y"),
        F.when(forward, speed).otherwise(-speed).alias("xVelocity"), F.lit(0.0).alias("xAcceleration"),
        F.when(alone, F.lit(0)).otherwise(user + 9).cast("long").alias("precedingId"),
        lane.alias("laneId"), F.lit(0.0).alias("dhw"), F.lit(0.0).alias("thw"), F.lit(0.0).alias("ttc"),
    )
    tracks_meta = events.select("user_id").distinct().select(
        *vehicle, F.when(truck, F.lit("Truck")).otherwise(F.lit("Car")).alias("class"),
        direction.alias("drivingDirection"),
    )
    recordings = events.select(recording.alias("id")).distinct().withColumn(
        "frameRate", F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.lit(1.0)))
    return RawTables(recordings, materialize(tracks_meta, "vehicles"), materialize(tracks, "tracks"))


def read_activity(spark: SparkSession, folder: str, p: Params = ACTIVITY_PARAMS) -> RawTables:
    return activity_tables(spark.read.parquet(f"{folder}/events.parquet"), p)
