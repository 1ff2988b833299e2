"""Hand-made raw tables and plain Python re-computations to compare with."""

from __future__ import annotations

import random

import numpy as np

from kerbline.schemas import NEIGHBOUR_IDS
from kerbline.sources.raw import RawTables

FRAME_SCHEMA = (
    "recordingId int, id long, frame long, x double, y double, width double, height double, xVelocity double, "
    "xAcceleration double, precedingId long, laneId long, dhw double, thw double, ttc double")
META_SCHEMA = "recordingId int, id long, width double, height double, class string, drivingDirection int"


def frame(rec=1, track=1, number=1, x=0.0, y=0.0, v=10.0, a=0.0, leader=0, lane=2, width=4.0, height=2.0,
          dhw=0.0, thw=0.0, ttc=0.0):
    return (rec, track, number, float(x), float(y), width, height, float(v), float(a), leader, lane, dhw, thw, ttc)


def vehicle(rec=1, track=1, width=4.0, height=2.0, kind="Car", direction=2):
    return (rec, track, width, height, kind, direction)


def raw_tables(spark, frames, vehicles, rates=((1, 25.0),)) -> RawTables:
    return RawTables(
        spark.createDataFrame(list(rates), "id int, frameRate double"),
        spark.createDataFrame(vehicles, META_SCHEMA),
        spark.createDataFrame(frames, FRAME_SCHEMA),
    )


def random_world(seed=1, lengths=(1, 4, 5, 6, 8, 9, 10, 30, 57), gaps=True):
    """Tracks of many lengths in two recordings, with random speeds, lanes and (some) missing frames."""
    rng = random.Random(seed)
    frames, vehicles = [], []
    for rec in (1, 2):
        for i, length in enumerate(lengths):
            track = i + 1
            direction = (1, 2, 3)[i % 3]
            vehicles.append(vehicle(rec, track, kind=("Car", "Truck", "Bus")[i % 3], direction=direction,
                                    width=rng.choice([4.0, 5.5, 12.0])))
            number = rng.randint(1, 20)
            for _ in range(length):
                frames.append(frame(rec, track, number, x=rng.uniform(0, 400), y=rng.uniform(0, 20),
                                    v=rng.uniform(15, 35), leader=rng.choice([0, 0, 1, 2, 9, 77]),
                                    lane=rng.choice([2, 2, 2, 3])))
                number += 1 if not gaps or rng.random() < 0.8 else rng.randint(2, 40)
    rng.shuffle(frames)
    return frames, vehicles


def savgol(values, derivative, window=9, order=3):
    """Polynomial fit around every sample; the fit window never leaves the track."""
    n = len(values)
    if n < order + 2:
        return [float(v) for v in values]
    size = min(window, n if n % 2 else n - 1)
    result = []
    for i in range(n):
        start = min(max(i - size // 2, 0), n - size)
        x = np.arange(start, start + size) - i
        fit = np.polynomial.Polynomial.fit(x, values[start:start + size], order).convert()
        result.append(float((fit.deriv() if derivative else fit)(0)))
    return result


def extra_ids():
    return [c for c in NEIGHBOUR_IDS if c != "precedingId"]
