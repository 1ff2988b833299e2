"""Savitzky-Golay smoothing along tracks.

The filter fits a polynomial to a window of rows and takes its value or slope at one of them. For a
fixed window and place in the window that is a fixed linear combination of the samples, so the whole
filter is arithmetic on ``lag``/``lead`` columns with weights looked up by (window, place).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kerbline.operators.tracks import piece_window
from kerbline.params import Params


def weights(window: int, order: int, place: int, derivative: int) -> list[float]:
    """Weights of the samples of a window for the fit at ``place``, by least squares."""
    offsets = np.arange(window, dtype=float) - place
    fit = np.linalg.pinv(np.vander(offsets, order + 1, increasing=True))
    return [float(w) for w in fit[derivative]]


def _weight_table(derivative: int, p: Params) -> str:
    """SQL array literal: one row of weights per (window, place), windows in descending size."""
    scale = (1.0 / p.accel_delta) ** derivative
    rows = []
    for window in _windows(p):
        for place in range(window):
            row = weights(window, p.smooth_order, place, derivative)
            rows.append("array(" + ",".join(f"{w * scale!r}D" for w in row) + ")")
    return "array(" + ",".join(rows) + ")"


def _windows(p: Params) -> list[int]:
    return list(range(p.smooth_window, p.smooth_order + 1, -2))


def with_smoothed(df: DataFrame, value: str, outputs: dict[str, int], p: Params) -> DataFrame:
    """Add filtered columns, ``outputs`` naming them by derivative; needs row_idx and n_rows.

    Away from the track's ends the window is centred. At the ends it stays inside the track and is
    evaluated off centre; shorter tracks use the largest odd window that fits, and tracks with fewer
    than order + 2 rows keep the raw value. Nearly all rows are centred in a full window: they take a
    plain sum with constant weights, and only the others look up samples and weights in arrays.
    """
    full, reach = p.smooth_window, p.smooth_window - 1
    over = piece_window()
    shifted = {f"_at{k}": F.lag(value, -k).over(over) for k in range(-reach, reach + 1) if k}
    sample = {k: f"`_at{k}`" if k else value for k in range(-reach, reach + 1)}
    sizes = _windows(p)
    size = "CASE " + " ".join(f"WHEN n_rows >= {w} THEN {w}" for w in sizes) + " END"
    first_row = "CASE _size " + " ".join(f"WHEN {w} THEN {sum(sizes[:i])}" for i, w in enumerate(sizes)) + " END"
    df = (
        df.withColumns(shifted)
        .withColumn("_size", F.expr(size))
        .withColumn("_place", F.expr(
            "int(CASE WHEN row_idx < _size div 2 THEN row_idx"
            " WHEN row_idx >= n_rows - _size div 2 THEN row_idx - n_rows + _size ELSE _size div 2 END)"))
        .withColumn("_centred", F.expr(f"_size = {full} AND _place = {full // 2}"))
        .withColumn("_samples", F.expr(
            f"IF(_centred, NULL, slice(array({','.join(sample.values())}), {full} - _place, _size))"))
    )
    filtered = {}
    for name, derivative in outputs.items():
        scale = (1.0 / p.accel_delta) ** derivative
        centred = " + ".join(
            f"{sample[k]} * {w * scale!r}D" for k, w in
            zip(range(-(full // 2), full // 2 + 1), weights(full, p.smooth_order, full // 2, derivative)))
        edge = (f"aggregate(zip_with(_samples, get({_weight_table(derivative, p)}, int({first_row} + _place)),"
                " (sample, weight) -> sample * weight), 0D, (total, term) -> total + term)")
        short = "NULL" if derivative and p.short_track_accel == "null" else f"double({value})"
        filtered[name] = F.expr(f"float(CASE WHEN _size IS NULL THEN {short} WHEN _centred THEN {centred} ELSE {edge} END)")
    return df.withColumns(filtered).drop(*shifted, "_size", "_place", "_centred", "_samples")
