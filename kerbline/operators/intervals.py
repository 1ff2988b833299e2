"""Intervals on tracks: runs of flagged rows, hopping windows, and slicing frames by interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.operators.tracks import PIECE, TRACK, piece_of
from kerbline.params import Params

MEET = "_meet"


def runs(flagged: DataFrame, measures: dict[str, tuple[Column, Column]], p: Params,
         also_by: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of rows adjacent in track order, from the rows that carry the flag.

    Needs ``row_idx`` and ``frame``. ``measures`` maps a result name to an aggregate over the rows of
    a partial run and the aggregate that merges partial runs. Tracks are cut into pieces, runs are
    found within each, and runs touching a border are joined up: only those meet per track.
    """
    keys = [*TRACK, *also_by]
    size = p.chunk_rows
    in_piece = Window.partitionBy(*keys, PIECE).orderBy("row_idx")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    pieced = flagged.withColumn(PIECE, piece_of(F.col("row_idx"), size))
    partial = (
        pieced.withColumn("_run", F.sum(_breaks(p, "row_idx", "row_idx", "frame", "frame", in_piece)).over(in_piece.rowsBetween(*so_far)))
        .groupBy(*keys, PIECE, "_run")
        .agg(
            F.min("row_idx").alias("_first"), F.max("row_idx").alias("_last"),
            F.min("frame").alias("run_start"), F.max("frame").alias("run_end"),
            F.count("*").alias("run_rows"), *[part.alias(name) for name, (part, _) in measures.items()],
        )
    )
    at_border = (F.col("_first") % size == 0) | (F.col("_last") % size == size - 1)
    together = Window.partitionBy(*keys, "_group").orderBy("_first")
    return (
        partial.withColumn("_group", F.when(at_border, F.lit(-1)).otherwise(F.col(PIECE)))
        .withColumn("_run", F.sum(_breaks(p, "_first", "_last", "run_start", "run_end", together)).over(together.rowsBetween(*so_far)))
        .groupBy(*keys, "_group", "_run")
        .agg(
            F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
            F.sum("run_rows").alias("run_rows"), *[merge.alias(name) for name, (_, merge) in measures.items()],
        )
        .drop("_group", "_run")
    )


def _breaks(p: Params, first: str, last: str, start: str, end: str, over) -> Column:
    """1 where a new run begins, 0 where the row continues the one before it."""
    continues = F.col(first) == F.lag(last).over(over) + 1
    if p.max_gap_frames is not None:
        continues = continues & (F.col(start) - F.lag(end).over(over) <= p.max_gap_frames + 1)
    return F.when(continues, F.lit(0)).otherwise(F.lit(1))


def hop_windows(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Copy each row into every window of ``size`` rows it belongs to; windows start every ``step`` rows.

    Adds ``window_no``. Windows that would run past the end of the track are left out.
    """
    idx = F.col("row_idx")
    last_full = F.floor((F.col("n_rows") - size) / F.lit(step))
    first = F.greatest(F.lit(0), F.ceil((idx - (size - 1)) / F.lit(step))).cast("long")
    last = F.least(F.floor(idx / F.lit(step)), last_full).cast("long")
    return (
        rows.filter(F.col("n_rows") >= size)
        .withColumns({"_from": first, "_to": last}).filter("_from <= _to")
        .withColumn("window_no", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    )


def slice_frames(frames: DataFrame, events: DataFrame, start: Column, end: Column, p: Params) -> DataFrame:
    """Frames inside each event's interval, both ends included; overlapping events get their own copies.

    ``events`` carries recordingId and ego_id, and must share no other column with ``frames``. Events
    and frames meet per stretch of ``join_chunk`` frames, so that neither a long track nor a track with
    many events makes a large join group.
    """
    size = p.join_chunk
    spans = (
        events.withColumns({"_start": start.cast("long"), "_end": end.cast("long")}).filter("_start <= _end")
        .withColumn(MEET, F.explode(F.sequence(piece_of(F.col("_start"), size), piece_of(F.col("_end"), size))))
        .withColumn("trackId", F.col("ego_id").cast("long"))
    )
    rows = frames.withColumn(MEET, piece_of(F.col("frame"), size))
    inside = (
        (rows["recordingId"] == spans["recordingId"]) & (rows["trackId"] == spans["trackId"])
        & (rows[MEET] == spans[MEET]) & rows["frame"].between(spans["_start"], spans["_end"])
    )
    return rows.join(spans, inside).drop(
        spans["recordingId"], spans["trackId"], spans[MEET], rows[MEET]).drop("_start", "_end")


def interval_bounds(columns: Sequence[str]) -> tuple[Column | None, Column | None]:
    """Start and end of an event table: the first of the known columns that has a value."""

    def first_of(*names: str) -> Column | None:
        present = [F.col(n) for n in names if n in columns]
        return F.coalesce(*present) if present else None

    return (first_of("start_frame", "conf_start_frame", "start"),
            first_of("end_frame", "conf_end_frame", "end"))
