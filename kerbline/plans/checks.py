"""Data-quality checks of an L1 table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.operators.quantiles import summarise
from kerbline.operators.tracks import TRACK, WORKING, with_shifted
from kerbline.params import Params
from kerbline.plans.profile import present_columns

# Columns and limits of the checks.
KEY_FIELDS = ("recordingId", "frame", "trackId", "s_long", "v_long_smooth", "veh_class", "drivingDirection")
OPTIONAL_FIELDS = ("TTC", "DRAC", "risk_level", "cpf_co2_rate_gps", "cpf_fuel_rate_lps", "vsp_co2_rate",
                   "vsp_nox_rate")
EMISSION_FIELDS = ("cpf_co2_rate_gps", "cpf_fuel_rate_lps", "vsp_co2_rate", "vsp_nox_rate")
NEGATIVE_SHARE_ALLOWED = 1e-3
EMISSION_LIMIT = 1e6


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _by_field(df: DataFrame, metrics: dict[str, list[Column]], names: Sequence[str]) -> DataFrame:
    """One aggregation over all fields, its single row turned into a row per field."""
    flat = [metric.alias(f"{field}|{name}") for field, row in metrics.items() for metric, name in zip(row, names)]
    entries = F.explode(F.array(*[
        F.struct(F.lit(field).alias("field"), *[F.col(f"`{field}|{name}`").alias(name) for name in names])
        for field in metrics]))
    return df.agg(*flat).select(entries.alias("_e")).select("_e.*")


def null_ratios(df: DataFrame, fields: Sequence[str] = KEY_FIELDS + OPTIONAL_FIELDS) -> DataFrame:
    used = present_columns(df, fields)
    return _by_field(df, {c: [_share(F.col(c).isNull())] for c in used}, ["null_ratio"])


def numeric_summary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    used = present_columns(df, fields)
    metrics = {c: [F.min(F.col(c).cast("double")), F.avg(F.col(c).cast("double")), F.max(F.col(c).cast("double"))]
               for c in used}
    return _by_field(df, metrics, ["min", "mean", "max"])


def backward_steps(l1: DataFrame, p: Params) -> DataFrame:
    """Steps against the driving direction, per track."""
    narrow = l1.select(*TRACK, "frame", "s_long", *present_columns(l1, WORKING))
    steps = with_shifted(narrow, {"_before": ("s_long", -1)}, p).withColumn("_step", F.col("s_long") - F.col("_before"))
    return steps.groupBy(*TRACK).agg(
        F.count(F.when(F.col("_step") < 0, 1)).alias("negative_count"), F.count("_step").alias("total_steps"),
    ).withColumn("negative_ratio", F.coalesce(F.try_divide("negative_count", "total_steps"), F.lit(0.0)))


def emission_checks(l1: DataFrame, fields: Sequence[str] = EMISSION_FIELDS,
                    allowed: float = NEGATIVE_SHARE_ALLOWED, limit: float = EMISSION_LIMIT) -> DataFrame:
    """Range and negative share per emission field, judged against the limits."""
    metrics = {}
    for c in present_columns(l1, fields):
        value = F.col(c).cast("double")
        metrics[c] = [F.min(value), F.avg(value), F.max(value), F.coalesce(_share(value < 0), F.lit(0.0))]
    return _by_field(l1, metrics, ["min", "mean", "max", "neg_ratio"]).withColumns({
        "exceeds_max": F.col("max") > limit,
        "neg_ratio_ok": F.when(F.col("max").isNotNull(), F.col("neg_ratio") <= allowed),
    })


def headway_check(l1: DataFrame) -> DataFrame:
    """Where there is a leader: share of positive raw headways, mean distance to the recomputed gap."""
    led = l1.filter("precedingId > 0")
    raw = F.col("dist_headway_raw")
    difference = F.abs(F.col("dist_headway") - raw.cast("double"))
    return led.agg(_share(F.coalesce(raw > 0, F.lit(False))).alias("pos_ratio"),
                   F.avg(difference).alias("mean_abs_diff"))


def ttc_quantiles(l1: DataFrame, p: Params, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """TTC quantiles over closing pairs with a positive gap."""
    closing = l1.filter("precedingId > 0 AND rel_velocity > 0 AND dist_headway > 0").select("TTC")
    return summarise(closing, [], [], [("TTC", lower, "q_low"), ("TTC", upper, "q_high")])


def track_quality(l1: DataFrame) -> DataFrame:
    """Shares used as acceptance limits: negative speeds, plausible accelerations and emission rates."""
    speed, accel = F.col("v_long_smooth"), F.col("a_long_smooth")
    co2, fuel = F.col("cpf_co2_rate_gps"), F.col("cpf_fuel_rate_lps")
    return l1.agg(
        F.count("*").alias("n_rows"), _share(speed < 0).alias("v_negative_ratio"),
        F.max(speed.cast("double")).alias("v_max"), _share(F.abs(accel) <= 10).alias("a_inside_ratio"),
        _share(co2 >= 0).alias("co2_nonneg_ratio"), _share(fuel >= 0).alias("fuel_nonneg_ratio"),
        F.max(co2.cast("double")).alias("co2_max"), F.max(fuel.cast("double")).alias("fuel_max"))


def raw_alignment(l1: DataFrame, raw_tracks: DataFrame) -> DataFrame:
    """Absolute differences between raw and processed position and speed, for every frame row."""
    raw = raw_tracks.select("recordingId", F.col("id").alias("trackId"), "frame", "x", "y", "xVelocity")
    built = l1.select("recordingId", "trackId", "frame", "drivingDirection", "x_raw", "y_raw", "v_long_raw").dropna()
    expected = F.when(F.col("drivingDirection") == 2, F.col("xVelocity")).otherwise(-F.col("xVelocity"))
    return built.join(raw, ["recordingId", "trackId", "frame"]).select(
        "recordingId", "trackId", "frame", F.abs(F.col("x") - F.col("x_raw")).alias("x_diff"),
        F.abs(F.col("y") - F.col("y_raw")).alias("y_diff"),
        F.abs(expected - F.col("v_long_raw")).alias("v_long_diff"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("recordingId").agg(
        F.count("*").alias("n_rows"), F.max("x_diff").alias("max_x_diff"), F.max("y_diff").alias("max_y_diff"),
        F.max("v_long_diff").alias("max_v_long_diff"))
