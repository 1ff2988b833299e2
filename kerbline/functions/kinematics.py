"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kerbline.params import Params

# Class codes, and the driving direction along which x grows.
CLASS_CODES = {"Car": 1, "Truck": 2}
FORWARD = 2
TRACKS_PER_RECORDING = 10000


def encode_class(name: Column) -> Column:
    code = F.lit(None)
    for label, value in CLASS_CODES.items():
        code = F.when(name == label, F.lit(value)).otherwise(code)
    return code.cast("byte")


def decode_class(code: Column) -> Column:
    """Class name of a code; anything else is passed on as text."""
    name = code.cast("string")
    for label, value in CLASS_CODES.items():
        name = F.when(code.cast("string") == str(value), F.lit(label)).otherwise(name)
    return name


def recode_class(column: Column) -> Column:
    """Class codes from a column that may hold codes or, in older tables, names."""
    text = column.cast("string")
    return F.coalesce(encode_class(text), text.try_cast("byte"))


def global_track_id(recording: Column, track: Column) -> Column:
    return recording.cast("long") * TRACKS_PER_RECORDING + track


def along_road(x: Column, width: Column, direction: Column, max_x: Column) -> Column:
    """Centre position growing in the driving direction."""
    centre = x + width / 2
    return F.when(direction == FORWARD, centre).otherwise(max_x - centre)


def along_direction(component: Column, direction: Column) -> Column:
    return F.when(direction == FORWARD, component).otherwise(-component)


def scale_to_box(value: Column, low: Column, high: Column, size: float) -> Column:
    return ((value - low) / F.greatest(high - low, F.lit(1e-6)) * F.lit(float(size))).cast("float")


def recording_name(recording: Column) -> Column:
    """``recording_NN``, at least two digits."""
    text = recording.cast("string")
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return F.concat(F.lit("recording_"), padded)


def recording_of_name(name: Column) -> Column:
    return F.regexp_extract(name, r"recording_(\d+)", 1).try_cast("int")


def add_image_coordinates(df, p: Params):
    return df.withColumns({
        "x_img": scale_to_box(F.col("x_raw"), F.col("min_x"), F.col("max_x"), p.image_width),
        "y_img": scale_to_box(F.col("y_raw"), F.col("min_y"), F.col("max_y"), p.image_height),
    })
