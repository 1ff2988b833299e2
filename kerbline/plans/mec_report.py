"""Tables that describe a MEC table: bins, quantiles, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.kinematics import decode_class
from kerbline.functions.rates import (
    DURATION_BINS, DURATION_LAST, SEVERITY_BINS, SEVERITY_LAST, UNKNOWN, duration_bin, severity_bin,
)
from kerbline.operators.ordered import number_rows
from kerbline.operators.quantiles import summarise
from kerbline.params import Params

# Older names of columns.
ALIASES = {
    "vehicle_class": "veh_class", "vehicleType": "veh_class", "ttc_min": "min_TTC_conf",
    "ttc_conf_min": "min_TTC_conf", "conf_dur": "conf_duration",
}
MEC = "MEC_CO2_per_km"


def normalise(mec: DataFrame, p: Params, order: tuple[str, ...] = ("rec_id", "ego_id", "conf_start_frame")) -> DataFrame:
    """Current column names, class names for codes, and defaults for event_id and flow_state.

    A missing event_id becomes the 0-based position of the row in the given order.
    """
    for old, new in ALIASES.items():
        if old in mec.columns and new not in mec.columns:
            mec = mec.withColumnRenamed(old, new)
    if "event_id" not in mec.columns:
        mec = number_rows(mec, [], [c for c in order if c in mec.columns], "event_id")
        mec = mec.withColumn("event_id", F.col("event_id") - 1)
    if "flow_state" not in mec.columns:
        mec = mec.withColumn("flow_state", F.lit(UNKNOWN))
    if "veh_class" in mec.columns:
        mec = mec.withColumn("veh_class", decode_class(F.col("veh_class")))
    return mec


def with_bins(mec: DataFrame) -> DataFrame:
    """Severity and duration bins; ``unknown`` throughout where the column to bin is missing."""
    severity = severity_bin(F.col("min_TTC_conf")) if "min_TTC_conf" in mec.columns else F.lit(UNKNOWN)
    length = duration_bin(F.col("conf_duration")) if "conf_duration" in mec.columns else F.lit(UNKNOWN)
    return mec.withColumns({"severity_bin": severity, "duration_bin": length})


def basic_stats(mec: DataFrame, p: Params) -> DataFrame:
    """Distribution of MEC per km: one row overall and one per severity bin and class.

    The group rows hold median and outer deciles only.
    """
    scopes = F.explode(F.array(F.lit("overall"), F.lit("by_group")))
    grouped = F.col("scope") == "by_group"
    rows = with_bins(normalise(mec, p)).withColumn("scope", scopes).withColumns({
        "severity_bin": F.when(grouped, F.col("severity_bin")),
        "veh_class": F.when(grouped, F.col("veh_class")),
    }).select("scope", "severity_bin", "veh_class", MEC)
    keys = ["scope", "severity_bin", "veh_class"]
    stats = summarise(
        rows, keys,
        [F.count(MEC).alias("count"), F.avg(MEC).alias("mean"), F.min(MEC).alias("min"), F.max(MEC).alias("max")],
        [(MEC, 0.5, "median"), (MEC, 0.1, "q10"), (MEC, 0.9, "q90")])
    overall = F.col("scope") == "overall"
    return stats.select(
        *keys, *[F.when(overall, F.col(c)).alias(c) for c in ("count", "mean")], "median",
        *[F.when(overall, F.col(c)).alias(c) for c in ("min", "max")], "q10", "q90")


def summary_table(mec: DataFrame, p: Params, complete: bool = False) -> DataFrame:
    """Mean rates by severity bin and flow state, and MEC's share of the real rate in percent.

    ``complete`` lists every severity bin for each flow state, also those without events.
    """
    rows = with_bins(normalise(mec, p))
    table = rows.groupBy("severity_bin", "flow_state").agg(
        F.count("event_id").alias("n_events"), F.avg("duration").alias("mean_duration_real"),
        F.avg("E_real_CO2_per_km").alias("mean_E_real_CO2_per_km"),
        F.avg("E_base_CO2_per_km").alias("mean_E_base_CO2_per_km"), F.avg(MEC).alias("mean_MEC_CO2_per_km"),
    ).withColumn("MEC_share_pct", F.try_divide("mean_MEC_CO2_per_km", "mean_E_real_CO2_per_km") * 100)
    if complete:
        labels = [name for _, name in SEVERITY_BINS] + [SEVERITY_LAST, UNKNOWN]
        every = F.explode(F.array(*[F.lit(label) for label in labels])).alias("severity_bin")
        grid = table.select("flow_state").distinct().select("flow_state", every)
        table = grid.join(table, ["severity_bin", "flow_state"], "left").fillna({"n_events": 0})
    return table


def bin_counts(mec: DataFrame, p: Params) -> DataFrame:
    return with_bins(normalise(mec, p)).groupBy("severity_bin", "duration_bin").agg(F.count("*").alias("n_events"))


def bin_labels() -> dict[str, list[str]]:
    """All labels in display order."""
    return {
        "severity_bin": [name for _, name in SEVERITY_BINS] + [SEVERITY_LAST, UNKNOWN],
        "duration_bin": [name for _, name in DURATION_BINS] + [DURATION_LAST, UNKNOWN],
    }


def headline(mec: DataFrame, p: Params) -> DataFrame:
    """Number of events, and median and outer deciles of the finite MEC values."""
    finite = mec.select(F.when(F.abs(F.col(MEC)) < float("inf"), F.col(MEC)).alias(MEC))
    return summarise(
        finite, [], [F.count("*").alias("n_events")],
        [(MEC, 0.5, "median"), (MEC, 0.1, "p10"), (MEC, 0.9, "p90")])


def bucket_medians(mec: DataFrame, p: Params) -> DataFrame:
    medians = summarise(mec, ["MEC_bucket"], [F.count("*").alias("n_events")], [(MEC, 0.5, "median_MEC_CO2_per_km")])
    return medians.orderBy("MEC_bucket")


def debug_summary(mec: DataFrame, p: Params) -> DataFrame:
    """Overall statistics stacked on the bucket medians; each row fills its own columns only."""
    per_event = "MEC_CO2_per_event"
    overall = summarise(
        mec, [],
        [F.count("*").alias("n_events"), F.avg(MEC).alias("mec_per_km_mean"), F.min(MEC).alias("mec_per_km_min"),
         F.max(MEC).alias("mec_per_km_max"), F.avg(per_event).alias("mec_per_event_mean")],
        [(MEC, 0.5, "mec_per_km_median"), (per_event, 0.5, "mec_per_event_median")],
    ).select("n_events", "mec_per_km_mean", "mec_per_km_median", "mec_per_km_min", "mec_per_km_max",
             "mec_per_event_mean", "mec_per_event_median")
    buckets = bucket_medians(mec, p).select(F.col("MEC_bucket").alias("min_TTC_bucket"), "median_MEC_CO2_per_km")
    return overall.unionByName(buckets, allowMissingColumns=True)
