"""The stages end to end: each reads what earlier stages wrote and writes its own tables.

    build_frames      raw CSV        -> <out>/l1
    build_event_tables <out>/l1       -> <out>/conflicts, <out>/baselines
    explore           l1, events     -> <out>/reports/l1_overall, l2_overall, ...
    build_costs       l1, events     -> <out>/mec, <out>/reports/mec_debug_summary
    report_costs      mec            -> <out>/reports/mec_basic_stats, mec_summary
    profile_behaviour mec, l1        -> <out>/clusters, <out>/reports/cluster_summary, cluster_curves
    couple            l1, conflicts  -> <out>/reports/aligned_curve, lag_stats, phase_density
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kerbline.operators.sampling import head_per_group
from kerbline.operators.tracks import WORKING
from kerbline.params import Params
from kerbline.plans import behaviour, coupling, events, l1, mec, mec_report, profile, sweep
from kerbline.schemas import BASELINES, CONFLICTS, L1
from kerbline.sources.raw import read_raw
from kerbline.sources.tables import read_recordings, read_table, write_csv, write_recordings, write_table

_WORKING_TYPES = {"row_idx": T.LongType(), "n_rows": T.LongType(), "lane_changed": T.BooleanType(), "frame_s": T.DoubleType()}
L1_STORED = T.StructType(L1.fields + [T.StructField(c, _WORKING_TYPES[c], True) for c in WORKING])
CONFLICTS_STORED = T.StructType(CONFLICTS.fields + [T.StructField("min_ttc_frame", T.LongType(), True)])


def build_frames(spark: SparkSession, raw_folder: str, out: str, p: Params = Params(),
                 ids: Sequence[int] | None = None) -> None:
    write_recordings(l1.working_frames(read_raw(spark, raw_folder, ids), p), f"{out}/l1", ids)


def read_frames(spark: SparkSession, out: str, ids: Sequence[int] | None = None, strict: bool = False) -> DataFrame:
    return read_recordings(spark, f"{out}/l1", L1_STORED, ids, strict)


def build_event_tables(spark: SparkSession, out: str, p: Params = Params(), ids: Sequence[int] | None = None,
                       ttc_conflict: float | None = None, min_duration: float | None = None) -> None:
    """Both thresholds can be overridden; a recording without frames is an error."""
    changes = {"ttc_conflict": ttc_conflict, "min_conflict_duration": min_duration}
    p = replace(p, **{name: value for name, value in changes.items() if value is not None})
    conflicts, baselines = events.build_events(read_frames(spark, out, ids, strict=ids is not None), p)
    write_recordings(conflicts, f"{out}/conflicts", ids)
    write_recordings(baselines, f"{out}/baselines", ids)


def read_events(spark: SparkSession, out: str, ids: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    return (read_recordings(spark, f"{out}/conflicts", CONFLICTS_STORED, ids),
            read_recordings(spark, f"{out}/baselines", BASELINES, ids))


def explore(spark: SparkSession, out: str, p: Params = Params(), ids: Sequence[int] | None = None) -> None:
    frames = read_frames(spark, out, ids)
    conflicts, baselines = read_events(spark, out, ids)
    reports = {
        "l1_overall_summary": profile.l1_profile(frames),
        "l1_sample": head_per_group(frames, ["recordingId"], ["trackId", "frame"], 5).drop(*WORKING),
        "l2_overall_summary": profile.l2_profile(conflicts, baselines, p),
        "l2_recordings": profile.recording_summary(conflicts, baselines, p),
        "l2_describe": profile.describe_events(conflicts, baselines, p),
        "l2_classes": profile.class_counts(conflicts, baselines),
    }
    _report(reports, out)


def build_costs(spark: SparkSession, out: str, p: Params = Params(), ids: Sequence[int] | None = None) -> None:
    table = mec.match_baselines(read_frames(spark, out, ids), *read_events(spark, out, ids), p)
    write_table(table, f"{out}/mec")
    _report({"mec_debug_summary": mec_report.debug_summary(read_table(spark, f"{out}/mec"), p)}, out)


def report_costs(spark: SparkSession, out: str, p: Params = Params()) -> None:
    table = read_table(spark, f"{out}/mec")
    _report({"mec_basic_stats": mec_report.basic_stats(table, p), "mec_summary": mec_report.summary_table(table, p)}, out)


def profile_behaviour(spark: SparkSession, out: str, p: Params = Params(), k: int = 3, all_features: bool = False) -> None:
    """Clusters use the four cost and severity features; ``all_features`` adds the kinematic ones."""
    frames = read_frames(spark, out)
    chosen = behaviour.clustering_events(read_table(spark, f"{out}/mec"))
    if all_features:
        chosen = behaviour.kinematic_extremes(frames, chosen, p)
    write_table(behaviour.cluster_events(chosen, k), f"{out}/clusters")
    clustered = read_table(spark, f"{out}/clusters")
    _report({"cluster_summary": behaviour.cluster_summary(clustered, p),
             "cluster_curves": behaviour.cluster_curves(frames, clustered, p)}, out)


def couple(spark: SparkSession, out: str, p: Params = Params(), ids: Sequence[int] | None = None) -> None:
    frames, (conflicts, _) = read_frames(spark, out, ids), read_events(spark, out, ids)
    _report({
        "aligned_curve": coupling.aligned_curve(frames, conflicts, p),
        "lag_stats": coupling.lag_stats(frames, conflicts, p),
        "phase_density": coupling.phase_density(frames, conflicts, p),
        "severe_trajectories": coupling.severe_trajectories(frames, conflicts, p),
    }, out)


def scan_thresholds(spark: SparkSession, out: str, p: Params = Params(), ids: Sequence[int] | None = None) -> None:
    _report({"threshold_sweep": sweep.threshold_sweep(read_frames(spark, out, ids), p)}, out)


def _report(tables: dict[str, DataFrame], out: str) -> None:
    for name, table in tables.items():
        write_csv(table, f"{out}/reports/{name}")
