"""Profiles of frame and event tables, per recording and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.kinematics import recording_of_name
from kerbline.operators.joins import null_safe_join
from kerbline.operators.quantiles import summarise
from kerbline.operators.store import materialize
from kerbline.params import Params
from kerbline.schemas import L1

# The columns each report looks at.
KEY_COLUMNS = ("recordingId", "frame", "trackId", "TTC", "v_long_smooth", "a_long_smooth", "cpf_co2_rate_gps",
               "cpf_fuel_rate_lps", "dt")
RATIO_COLUMNS = {"ttc_notnull_ratio": "TTC", "co2_notnull_ratio": "cpf_co2_rate_gps",
                 "fuel_notnull_ratio": "cpf_fuel_rate_lps"}
CONFLICT_FIELDS = ("conf_duration", "min_TTC_conf", "duration", "E_cpf_CO2", "E_cpf_fuel")
BASELINE_FIELDS = ("min_TTC", "duration", "E_cpf_CO2", "E_cpf_fuel")
SUMMARY_COLUMNS = ("min_TTC_conf", "conf_duration", "E_cpf_CO2")


def missing_columns(df: DataFrame, wanted: Sequence[str] = KEY_COLUMNS) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def schema_listing(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def l1_profile(l1: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Rows, columns and filled shares per recording. ``recordings`` (rec_id) adds those without rows."""
    ratios = [
        (_share(F.col(c).isNotNull()) if c in l1.columns else F.lit(None).cast("double")).alias(name)
        for name, c in RATIO_COLUMNS.items()
    ]
    columns = len([c for c in l1.columns if c in L1.names])
    profile = l1.groupBy(F.col("recordingId").alias("rec_id")).agg(
        F.count("*").alias("n_rows"), F.lit(columns).cast("long").alias("n_cols"), *ratios)
    if recordings is not None:
        profile = recordings.select("rec_id").join(profile, "rec_id", "left").fillna(0)
    return profile


def l1_overall(profile: DataFrame) -> DataFrame:
    return profile.agg(F.count("*").alias("n_recordings"), F.sum("n_rows").alias("total_frames"),
                       F.avg("n_rows").alias("mean_frames"))


def l2_profile(conflicts: DataFrame, baselines: DataFrame, p: Params) -> DataFrame:
    """Event counts and conflict medians per recording."""
    conf = summarise(
        conflicts, ["recordingId"], [F.count("*").alias("n_conf")],
        [("conf_duration", 0.5, "median_conf_duration"), ("min_TTC_conf", 0.5, "median_min_TTC_conf"),
         ("E_cpf_CO2", 0.5, "median_E_cpf_CO2_conf")])
    base = baselines.groupBy("recordingId").agg(F.count("*").alias("n_base"))
    return conf.join(base, "recordingId", "full").select(
        F.col("recordingId").alias("rec_id"), F.coalesce("n_conf", F.lit(0)).alias("n_conf"),
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "median_conf_duration", "median_min_TTC_conf", "median_E_cpf_CO2_conf")


def l2_overall(profile: DataFrame, p: Params) -> DataFrame:
    """Totals, and medians over the recordings' medians."""
    medians = ("median_conf_duration", "median_min_TTC_conf", "median_E_cpf_CO2_conf")
    # A row per recording, itself made of quantiles: kept, as both passes read it.
    profile = materialize(profile, "l2-profile")
    return summarise(
        profile, [], [F.sum("n_conf").alias("total_conf"), F.sum("n_base").alias("total_base")],
        [(c, 0.5, c) for c in medians])


def recording_summary(conflicts: DataFrame, baselines: DataFrame, p: Params) -> DataFrame:
    """Event counts per recording, median and sum of the main conflict figures."""
    used = present_columns(conflicts, SUMMARY_COLUMNS)
    conf = summarise(
        conflicts, ["recordingId"],
        [F.count("*").alias("conflict_events"), *[F.sum(c).alias(f"{c}_sum") for c in used]],
        [(c, 0.5, f"{c}_median") for c in used])
    base = baselines.groupBy("recordingId").agg(F.count("*").alias("baseline_events"))
    return conf.join(base, "recordingId", "full").select(
        F.col("recordingId").alias("recording"),
        F.coalesce("conflict_events", F.lit(0)).alias("conflict_events"),
        F.coalesce("baseline_events", F.lit(0)).alias("baseline_events"),
        *[f"{c}_{kind}" for c in used for kind in ("median", "sum")])


def recording_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """Recording ids of folder names such as recording_07."""
    return names.withColumn("recordingId", recording_of_name(F.col(column)))


def describe(df: DataFrame, fields: Sequence[str], p: Params, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each field that is present, one row per field."""
    used = present_columns(df, fields)
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in used]))
    rows = df.select(*by, entries.alias("_e")).select(*by, "_e.field", "_e.value")
    return summarise(
        rows, [*by, "field"],
        [F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
         F.min("value").alias("min"), F.max("value").alias("max")],
        [("value", 0.25, "q25"), ("value", 0.5, "q50"), ("value", 0.75, "q75")])


def describe_events(conflicts: DataFrame, baselines: DataFrame, p: Params) -> DataFrame:
    """Both event tables described in long form; conflicts also by CO2 per second."""
    per_s = conflicts.withColumn("E_cpf_CO2_per_s", F.try_divide("E_cpf_CO2", "duration"))
    conf = describe(per_s, [*CONFLICT_FIELDS, "E_cpf_CO2_per_s"], p).withColumn("event_type", F.lit("conflict"))
    base = describe(baselines, BASELINE_FIELDS, p).withColumn("event_type", F.lit("baseline"))
    return conf.unionByName(base)


def class_counts(conflicts: DataFrame, baselines: DataFrame, keep_null: bool = True) -> DataFrame:
    """Events per vehicle class, most frequent first."""
    both = conflicts.select(F.lit("conflict").alias("event_type"), "veh_class").unionByName(
        baselines.select(F.lit("baseline").alias("event_type"), "veh_class"))
    if not keep_null:
        both = both.dropna(subset=["veh_class"])
    counts = both.groupBy("event_type", "veh_class").agg(F.count("*").alias("count"))
    return counts.orderBy("event_type", F.desc("count"), "veh_class")


def row_drift(raw_tracks: DataFrame, l1: DataFrame) -> DataFrame:
    """Relative difference in row count between raw tracks and L1, per recording."""
    raw = raw_tracks.groupBy("recordingId").agg(F.count("*").alias("raw_rows"))
    built = l1.groupBy("recordingId").agg(F.count("*").alias("l1_rows"))
    return null_safe_join(raw, built, ["recordingId"], "left").fillna({"l1_rows": 0}).withColumn(
        "diff_ratio", F.abs(F.col("l1_rows") - F.col("raw_rows")) / F.col("raw_rows"))
