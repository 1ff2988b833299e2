"""The registered queries: every operator run over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kerbline.functions.emissions import add_fuel_model, add_specific_power
from kerbline.functions.kinematics import add_image_coordinates, recording_name
from kerbline.functions.safety import add_interaction, add_safety
from kerbline.operators.sampling import head_per_group, sample_keys, sample_rows
from kerbline.operators.store import replacing
from kerbline.operators.tracks import HALO
from kerbline.plans import behaviour, checks, coupling, events, l1, mec, mec_report, profile, sweep, views
from kerbline.plans.workspace import Workspace, open_workspace
from kerbline.sources.raw import only_recordings, select_recordings

KEYS = ("recordingId", "trackId", "frame")
SCALE = 10_000
# Small quantities are compared to more decimals.
FINE_SCALE = 10_000_000
FINE = ("cpf_fuel_rate_lps", "vsp_value", "vsp_co2_rate", "vsp_nox_rate", "E_cpf_fuel", "E_vsp_NOx", "E_fuel", "E_real_fuel", "E_base_fuel")
# Columns that may hold infinity.
UNBOUNDED = ("DRAC",)


def neat(df: DataFrame) -> DataFrame:
    """Common types for comparison: whole numbers as BIGINT, others as DOUBLE, rounded; infinity as null.

    Rounds by plain arithmetic, since ``round`` goes through decimals, digit by digit.
    """
    columns = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            wide = f"CAST({name} AS DOUBLE)"
            if field.name in UNBOUNDED:
                wide = f"nullif({wide}, double('Infinity'))"
            scale = FINE_SCALE if field.name in FINE else SCALE
            columns.append(f"floor({wide} * {scale} + 0.5D) / {scale}D AS {name}")
        elif isinstance(field.dataType, T.IntegralType):
            columns.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            columns.append(name)
    return df.selectExpr(*columns)


def _keyed(ws: Workspace) -> DataFrame:
    return l1.keyed_frames(ws.raw, ws.p, ws.pieces).filter(~F.col(HALO))


def _l1_keys(ws):
    return _keyed(ws).select(*KEYS, "global_track_id", "time", "veh_class", "width", "height", "laneId_raw", "dt",
                             "n_rows")


def _l1_unify(ws):
    return _keyed(ws).select(*KEYS, "drivingDirection", "s_long", "d_lat", "v_long_raw", "a_long_raw")


def _l1_extents(ws):
    return l1.recording_table(ws.raw, ws.pieces, ws.p)


def _l1_minmax(ws):
    return add_image_coordinates(_keyed(ws), ws.p).select(*KEYS, "x_img", "y_img")


def _l1_savgol(ws):
    return ws.smoothed.select(*KEYS, "v_long_smooth", "a_long_smooth")


def _l1_leader(ws):
    return add_interaction(l1.with_leader(ws.smoothed)).select(
        *KEYS, "leader_s_long", "leader_v_long", "leader_a_long", "dist_headway", "rel_velocity", "time_headway")


def _l1_safety(ws):
    led = add_interaction(l1.with_leader(ws.smoothed))
    return add_safety(led, ws.p).select(*KEYS, "TTC", "DRAC", "risk_level")


def _l1_fuel(ws):
    return add_fuel_model(ws.smoothed).select(
        *KEYS, "vehicle_type", "v_kmh", "a_kmhps", "cpf_power_kw", "cpf_fuel_rate_lps", "cpf_co2_rate_gps")


def _l1_vsp(ws):
    return add_specific_power(add_fuel_model(ws.smoothed), ws.p).select(
        *KEYS, "vsp_value", "vsp_co2_rate", "vsp_nox_rate")


def _islands(ws):
    return events.conflict_runs(ws.event_frames, ws.p).select(
        "recordingId", "trackId", "run_start", "run_end", "run_rows", "conf_duration", "min_TTC_conf")


def _kinds(ws):
    return {"conflict": ws.conflicts, "baseline": ws.baselines}


def _selected(ws):
    ids = select_recordings("1-2,4")
    return only_recordings(ws.l1, ids, strict=True).groupBy("recordingId").agg(F.count("*").alias("n_rows")).select(
        "*", recording_name(F.col("recordingId")).alias("name"))


def _clusters(ws):
    mec_table = behaviour.clustering_events(ws.mec)
    return behaviour.cluster_events(mec_table).select(
        "rec_id", "event_id", "min_TTC_conf", "conf_duration", "MEC_CO2_per_km", "E_real_CO2_per_km", "cluster")


def _cluster_features(ws):
    scaled, used = behaviour.scaled_features(behaviour.clustering_events(ws.mec))
    return behaviour.feature_array(scaled).select(
        "rec_id", "event_id", *[F.get("features_z", F.lit(i)).alias(f"z_{c}") for i, c in enumerate(used)])


def _cluster_facts(ws):
    clustered = _clustered(ws)
    return behaviour.cluster_facts(clustered, behaviour.cluster_summary(clustered, ws.p))


def _match_varied(ws):
    """Severe conflicts against the nearest milder one: unlike baseline windows these have many different durations."""
    milder = F.col("min_TTC_conf") >= 2.0
    return mec.match_baselines(ws.event_frames, ws.conflicts.filter(~milder), ws.conflicts.filter(milder), ws.p).select(
        "rec_id", "event_id", "l2_event_id", "base_event_id", "duration", "duration_base", "mean_v_conf", "mean_v_base", "MEC_CO2_per_event")


def _renamed_costs(ws):
    """Headline figures of a cost table that carries older column names and no event numbers."""
    older = {new: old for old, new in mec_report.ALIASES.items() if new in ws.mec.columns}
    return mec_report.headline(mec_report.normalise(ws.mec.withColumnsRenamed(older).drop("event_id"), ws.p), ws.p)


def _clustered(ws):
    return ws.table("clusters", lambda: behaviour.cluster_events(behaviour.clustering_events(ws.mec)))


CATALOG: dict[str, Callable[[Workspace], DataFrame]] = {
    "l1_keys_and_meta": _l1_keys,
    "l1_recording_extents": _l1_extents,
    "l1_unify_coordinates": _l1_unify,
    "l1_minmax_scale": _l1_minmax,
    "l1_savgol": _l1_savgol,
    "l1_leader_join": _l1_leader,
    "l1_ttc_drac_risk": _l1_safety,
    "l1_cpfm": _l1_fuel,
    "l1_vsp": _l1_vsp,
    "l1_master": lambda ws: l1.master_frames(ws.raw, ws.p, ws.smoothed),
    "l2_islands": _islands,
    "l2_conflict_events": lambda ws: events.conflict_events(ws.event_frames, ws.p).drop("min_ttc_frame"),
    "l2_baseline_events": lambda ws: events.baseline_events(ws.event_frames, ws.p),
    "episode_metrics": lambda ws: mec.episode_metrics(ws.event_frames, _kinds(ws), ws.p),
    "episode_kinematics": lambda ws: behaviour.kinematic_extremes(ws.event_frames, ws.conflicts, ws.p).select(
        "recordingId", "event_id", "max_decel", "max_accel", "v_drop"),
    "mec_match": lambda ws: mec.match_baselines(ws.event_frames, ws.conflicts, ws.baselines, ws.p).select(
        "rec_id", "event_id", "l2_event_id", "ego_id", "veh_class", "flow_state", "min_TTC_conf", "conf_duration",
        "duration", "duration_base", "dist_real_m", "dist_base_m", "E_real_CO2", "E_real_fuel", "E_base_CO2",
        "E_base_fuel", "mean_v_conf", "mean_v_base", "E_real_CO2_per_km", "E_base_CO2_per_km", "E_real_CO2_per_s",
        "E_base_CO2_per_s", "MEC_CO2_per_km", "MEC_CO2_per_event", "MEC_bucket", "base_event_id", "base_ego_id",
        "base_start_frame", "base_end_frame", "base_mean_TTC"),
    "mec_match_varied": _match_varied,
    "mec_headline": lambda ws: mec_report.headline(ws.mec, ws.p),
    "mec_bucket_median": lambda ws: mec_report.bucket_medians(ws.mec, ws.p),
    "mec_debug_summary": lambda ws: mec_report.debug_summary(ws.mec, ws.p),
    "mec_basic_stats": lambda ws: mec_report.basic_stats(ws.mec, ws.p),
    "mec_summary": lambda ws: mec_report.summary_table(ws.mec, ws.p),
    "severity_duration_bins": lambda ws: mec_report.bin_counts(ws.mec, ws.p),
    "threshold_sweep": lambda ws: sweep.threshold_sweep(ws.event_frames, ws.p),
    "l1_profile": lambda ws: profile.l1_profile(ws.l1),
    "l1_overall": lambda ws: profile.l1_overall(profile.l1_profile(ws.l1)),
    "l2_profile": lambda ws: profile.l2_profile(ws.conflicts, ws.baselines, ws.p),
    "l2_overall": lambda ws: profile.l2_overall(profile.l2_profile(ws.conflicts, ws.baselines, ws.p), ws.p),
    "l2_recording_summary": lambda ws: profile.recording_summary(ws.conflicts, ws.baselines, ws.p),
    "l2_describe": lambda ws: profile.describe_events(ws.conflicts, ws.baselines, ws.p),
    "l2_value_counts": lambda ws: profile.class_counts(ws.conflicts, ws.baselines),
    "dq_null_ratio": lambda ws: checks.null_ratios(ws.l1),
    "dq_numeric_summary": lambda ws: checks.numeric_summary(ws.l1, ["v_long_smooth", "a_long_smooth"]),
    "dq_monotonic": lambda ws: checks.backward_steps(ws.l1, ws.p),
    "dq_emissions": lambda ws: checks.emission_checks(ws.l1),
    "dq_headway": lambda ws: checks.headway_check(ws.l1),
    "dq_ttc_quantiles": lambda ws: checks.ttc_quantiles(ws.l1, ws.p),
    "dq_ttc_quantiles_closing": lambda ws: checks.ttc_quantiles(
        add_safety(ws.l1, replace(ws.p, ttc_convention="closing")), ws.p),
    "dq_track_quality": lambda ws: checks.track_quality(ws.l1),
    "dq_raw_alignment": lambda ws: checks.raw_alignment(ws.l1, ws.raw.tracks),
    "dq_row_drift": lambda ws: profile.row_drift(ws.raw.tracks, ws.l1),
    "recording_selection": _selected,
    "head_sample": lambda ws: head_per_group(ws.l1, ["recordingId"], ["trackId", "frame"], 5).select(
        *KEYS, "s_long", "v_long_smooth"),
    "sample_tracks": lambda ws: sample_keys(ws.l1, ["recordingId", "trackId"], 5),
    "sample_events": lambda ws: sample_rows(ws.conflicts, ["recordingId", "event_id"], 10).select(
        "recordingId", "event_id", "ego_id", "start_frame", "end_frame"),
    "frame_snapshot": lambda ws: views.frame_snapshot(ws.l1, 25),
    "track_profile": lambda ws: views.track_profile(ws.l1, 2, 2),
    "event_trace": lambda ws: views.event_trace(ws.l1, ws.conflicts, ws.p),
    "aligned_series": lambda ws: coupling.aligned_series(ws.l1, ws.conflicts, ws.p),
    "aligned_curve": lambda ws: coupling.aligned_curve(ws.l1, ws.conflicts, ws.p),
    "episode_lags": lambda ws: coupling.lags(ws.l1, ws.conflicts, ws.p),
    "lag_stats": lambda ws: coupling.lag_stats(ws.l1, ws.conflicts, ws.p),
    "phase_plane_samples": lambda ws: coupling.phase_samples(ws.l1, ws.conflicts, ws.p),
    "phase_plane_hexbin": lambda ws: coupling.phase_density(ws.l1, ws.conflicts, ws.p),
    "severe_topk": lambda ws: coupling.severe_conflicts(ws.conflicts).select(
        "recordingId", "event_id", "ego_id", "min_TTC_conf", "conf_duration"),
    "severe_trajectories": lambda ws: coupling.severe_trajectories(ws.l1, ws.conflicts, ws.p),
    "cluster_input": lambda ws: behaviour.clustering_events(ws.mec).select(
        "rec_id", "event_id", "min_TTC_conf", "conf_duration", "MEC_CO2_per_km", "E_real_CO2_per_km"),
    "cluster_features": _cluster_features,
    "cluster_facts": _cluster_facts,
    "mec_headline_of_older_names": _renamed_costs,
    "episode_metrics_from_times": lambda ws: mec.episode_metrics(ws.event_frames.drop("dt", "frame_s"), _kinds(ws), ws.p),
    "clusters": _clusters,
    "cluster_summary": lambda ws: behaviour.cluster_summary(_clustered(ws), ws.p),
    "cluster_curves": lambda ws: behaviour.cluster_curves(ws.l1, _clustered(ws), ws.p),
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """The query's result. Scratch tables that its last run in this session wrote are deleted."""
    workspace = open_workspace(spark, folder)
    with replacing(spark, f"{name} of {folder}"):
        return neat(CATALOG[name](workspace))
