"""Parameters of the analysis. Every operator takes one ``Params`` value; nothing is read from globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Frame rate used where the recording metadata has none.
    frame_rate: float = 25.0

    # Recordings of the quick test selection.
    test_recordings: tuple[int, ...] = (1,)

    # Smoothing: window length in rows and polynomial order.
    smooth_window: int = 9
    smooth_order: int = 3
    # Distance between samples in the derivative. 1.0 gives speed change per frame (the established
    # behaviour); 1/frame_rate gives m/s^2.
    accel_delta: float = 1.0
    # Acceleration of tracks too short to smooth: "speed" repeats the raw speed (the established
    # behaviour), "null" leaves it empty.
    short_track_accel: str = "speed"

    # Safety. recompute=False takes TTC from the raw tracks instead of the smoothed kinematics.
    recompute_safety: bool = True
    # "opening" divides the gap by (leader speed - own speed), the established behaviour;
    # "closing" divides by (own speed - leader speed).
    ttc_convention: str = "opening"
    ttc_high_risk: float = 2.0
    ttc_low_risk: float = 4.0
    reaction_time: float = 1.0

    # Specific-power model: True gives trucks the truck mass, False uses the car mass throughout.
    vsp_mass_by_class: bool = False

    # Target box of the image coordinates.
    image_width: float = 1280.0
    image_height: float = 720.0

    # Conflict episodes.
    ttc_conflict: float = 4.0
    min_conflict_duration: float = 0.4
    min_conflict_frames: int | None = None
    pre_event_time: float = 3.0
    post_event_time: float = 5.0
    # None: runs follow row order across missing frames. A number breaks a run at larger frame steps.
    max_gap_frames: int | None = None

    # Baseline windows.
    ttc_baseline: float = 4.0
    accel_baseline: float = 0.5
    baseline_window_time: float = 8.0
    baseline_step_time: float = 4.0

    # Baseline matching: duration band, and the scales of the squared distance.
    match_band: float = 2.0
    match_duration_scale: float = 2.0
    match_speed_scale: float = 5.0

    # Every track has a row for each frame between its first and last one. Saves a shuffle; a track
    # that breaks the promise raises an error. False accepts any frame numbers.
    consecutive_frames: bool = False
    # Every frame row must have vehicle metadata; False lets rows without it through.
    strict_metadata: bool = True

    # Physical layout. A track is worked on in pieces of ``chunk_rows`` rows, so that no task ever
    # holds a whole track; interval joins meet in pieces of ``join_chunk`` frames.
    chunk_rows: int = 65536
    join_chunk: int = 256

    def frames(self, seconds: float) -> int:
        """Whole frames in a time span, halves to even."""
        return int(round(seconds * self.frame_rate))
