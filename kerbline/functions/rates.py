"""Expressions on event level: rates per distance and time, bins, duration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Bin labels.
UNKNOWN = "unknown"
TTC_BUCKETS = ((2.0, "<2"), (3.0, "2-3"), (4.0, "3-4"))
TTC_BUCKET_LAST = ">=4"
SEVERITY_BINS = ((2.0, "<=2s"), (3.0, "(2,3]s"), (4.0, "(3,4]s"))
SEVERITY_LAST = ">4s"
DURATION_BINS = ((0.4, "<=0.4s"), (0.6, "(0.4,0.6]s"), (0.8, "(0.6,0.8]s"), (1.0, "(0.8,1.0]s"))
DURATION_LAST = ">1.0s"


def per_km(amount: Column, distance_m: Column) -> Column:
    return F.when(distance_m > 1e-6, amount / (distance_m / 1000.0))


def per_second(amount: Column, duration: Column) -> Column:
    return F.when(duration > 0, amount / duration)


def ttc_bucket(min_ttc: Column) -> Column:
    """Left-closed buckets."""
    label = F.when(min_ttc.isNull(), F.lit(UNKNOWN))
    for upper, name in TTC_BUCKETS:
        label = label.when(min_ttc < upper, F.lit(name))
    return label.otherwise(F.lit(TTC_BUCKET_LAST))


def _right_closed(value: Column, bins: Sequence[tuple[float, str]], last: str) -> Column:
    label = F.when(value.isNull() | (value < 0), F.lit(UNKNOWN))
    for upper, name in bins:
        label = label.when(value <= upper, F.lit(name))
    return label.otherwise(F.lit(last))


def severity_bin(min_ttc_conf: Column) -> Column:
    return _right_closed(min_ttc_conf, SEVERITY_BINS, SEVERITY_LAST)


def duration_bin(conf_duration: Column) -> Column:
    return _right_closed(conf_duration, DURATION_BINS, DURATION_LAST)


def frame_seconds(columns: Sequence[str], default_rate: float) -> Column:
    """Length of a row's frame: the exact one where the table has it, else ``dt``, else that of the default rate."""
    exact = [F.col("frame_s")] if "frame_s" in columns else []
    stored = [F.col("dt").cast("double")] if "dt" in columns else []
    return F.coalesce(*[F.when(c > 0, c) for c in [*exact, *stored]], F.lit(1.0 / default_rate))


def total_seconds(frame_length: Column, known: Column, first: Column, last: Column, default_rate: float) -> Column:
    """Sum of frame lengths, free of the noise of summing; without any ``known`` length the span of frames at the default rate."""
    return F.when(known > 0, F.round(frame_length, 9)).otherwise((last - first + 1) / F.lit(float(default_rate)))


def reaches(seconds: Column, threshold: float) -> Column:
    """Whether a duration reaches a threshold; lengths stored in single precision are given their last digit."""
    return seconds >= F.lit(float(threshold) * (1 - 1e-6))


def integral(rate: Column, frame_length: Column) -> Column:
    """Rate times length, unknown rates counting nothing."""
    return F.coalesce(F.sum(rate.cast("double") * frame_length), F.lit(0.0))
