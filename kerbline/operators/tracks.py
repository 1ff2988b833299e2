"""Row order within tracks, in pieces of bounded size.

A track can be arbitrarily long, so nothing here partitions a window by track alone. (recordingId,
trackId, frame) is unique, hence a piece of ``chunk_rows`` frame numbers holds at most that many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.params import Params

TRACK = ("recordingId", "trackId")
PIECE = "_piece"
HALO = "_halo"
# Working columns an L1 table carries besides the published ones.
WORKING = ("row_idx", "n_rows", "lane_changed", "frame_s")


def piece_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def with_halo(df: DataFrame, position: str, size: int, before: int, after: int) -> DataFrame:
    """Assign rows to pieces, copying the rows next to a border into the neighbouring piece.

    Afterwards every piece holds, besides its own rows, up to ``before`` preceding and ``after``
    following rows marked as halo; with consecutive positions those are exactly the neighbours.
    """
    if size < max(before, after):
        raise ValueError("pieces must be at least as long as their halo")
    pos = F.col(position)
    reached = F.sequence(piece_of(pos - after, size), piece_of(pos + before, size))
    return df.withColumn(PIECE, F.explode(reached)).withColumn(HALO, F.col(PIECE) != piece_of(pos, size))


def track_pieces(frames: DataFrame, p: Params, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (track, piece of frame numbers): rows before the piece and in the whole track.

    Aggregated map-side; the window then sees one row per piece, not per frame. ``extra`` are named
    aggregates to take along.
    """
    per_piece = (
        frames.groupBy(*TRACK, piece_of(F.col("frame"), p.chunk_rows).alias(PIECE))
        .agg(F.count("*").alias("_rows"), F.min("frame").alias("_lo"), F.max("frame").alias("_hi"), *extra)
    )
    track = Window.partitionBy(*TRACK)
    earlier = track.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = per_piece.withColumns({
        "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        "n_rows": F.sum("_rows").over(track),
        "_first_frame": F.min("_lo").over(track),
    })
    first = F.col("_first_frame")
    if p.consecutive_frames:
        whole = (F.col("_lo") == first + F.col("_rows_before")) & (F.col("_hi") == F.col("_lo") + F.col("_rows") - 1)
        first = F.when(whole, first).otherwise(
            F.raise_error(F.lit("a track has missing or repeated frames: set consecutive_frames=False")))
    return pieces.withColumn("_first_frame", first.cast("long")).drop("_rows", "_lo", "_hi")


def index_and_halo(frames: DataFrame, pieces: DataFrame, p: Params, before: int, after: int) -> DataFrame:
    """Rows with ``row_idx`` (0-based within the track), ``n_rows``, the columns of ``pieces``, and halos.

    With consecutive frames the row index is a subtraction, so rows are cut by frame number and one
    shuffle serves this join and the window functions that follow. Otherwise rows are counted within
    their piece first, and then cut by row index.
    """
    by_piece = [*TRACK, PIECE]
    if p.consecutive_frames:
        cut = with_halo(frames, "frame", p.chunk_rows, before, after)
        return (
            cut.join(pieces, by_piece)
            .withColumn("row_idx", F.col("frame") - F.col("_first_frame"))
            .drop("_rows_before", "_first_frame")
        )
    within = Window.partitionBy(*by_piece).orderBy("frame")
    indexed = (
        frames.withColumn(PIECE, piece_of(F.col("frame"), p.chunk_rows)).join(pieces, by_piece)
        .withColumn("row_idx", F.col("_rows_before") + F.row_number().over(within) - 1)
        .drop(PIECE, "_rows_before", "_first_frame")
    )
    return with_halo(indexed, "row_idx", p.chunk_rows, before, after)


def piece_window():
    return Window.partitionBy(*TRACK, PIECE).orderBy("row_idx")


def lane_changed() -> Column:
    """Whether the lane differs from the previous row's; unknown lanes and first rows count as different."""
    return F.coalesce(F.col("laneId_raw") != F.lag("laneId_raw").over(piece_window()), F.lit(True))


def _pieced(l1: DataFrame, p: Params, before: int, after: int) -> DataFrame:
    """Rows in pieces with halo; a table that knows its row order is cut without looking at the tracks."""
    if {"row_idx", "n_rows"} <= set(l1.columns):
        return with_halo(l1, "row_idx", p.chunk_rows, before, after)
    return index_and_halo(l1, track_pieces(l1, p), p, before, after)


def with_working_columns(l1: DataFrame, p: Params) -> DataFrame:
    """Add the working columns to an L1 table that came without them; without lanes no lane ever changes.

    The exact frame length (``frame_s``) is not made up: where it is missing, lengths follow ``dt``.
    """
    if {"row_idx", "n_rows", "lane_changed"} <= set(l1.columns):
        return l1
    rows = _pieced(l1, p, before=1, after=0)
    if "laneId_raw" not in rows.columns:
        return rows.withColumn("lane_changed", F.lit(False)).filter(~F.col(HALO)).drop(HALO, PIECE)
    return rows.withColumn("lane_changed", lane_changed()).filter(~F.col(HALO)).drop(HALO, PIECE)


def with_shifted(l1: DataFrame, shifted: dict[str, tuple[str, int]], p: Params) -> DataFrame:
    """Add columns taken from another row of the track: ``name: (column, rows ahead)``, -1 the row before."""
    steps = [k for _, k in shifted.values()]
    rows = _pieced(l1, p, before=max(0, -min(steps)), after=max(0, max(steps)))
    lagged = {name: F.lag(column, -k).over(piece_window()) for name, (column, k) in shifted.items()}
    return rows.withColumns(lagged).filter(~F.col(HALO)).drop(HALO, PIECE)
