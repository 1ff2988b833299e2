"""Marginal emission cost (MEC): each conflict against its nearest calm baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.rates import frame_seconds, per_km, per_second, ttc_bucket
from kerbline.operators.intervals import interval_bounds, slice_frames
from kerbline.operators.matching import nearest_by_speed
from kerbline.operators.store import materialize
from kerbline.operators.tracks import with_shifted
from kerbline.params import Params

KIND = "kind"
# Event columns a MEC table takes along, so that later stages find the frames again.
CARRIED = ("start_frame", "end_frame", "conf_start_frame", "conf_end_frame", "min_ttc_frame")


def _spans(events: DataFrame, kind: str) -> DataFrame:
    start, end = interval_bounds(events.columns)
    own_duration = F.col("duration") if "duration" in events.columns else F.lit(None)
    return events.select(
        F.lit(kind).alias(KIND), "recordingId", "event_id", F.col("ego_id").cast("long").alias("ego_id"),
        start.cast("long").alias("_from"), end.cast("long").alias("_upto"),
        own_duration.cast("double").alias("_own_duration"))


def episode_metrics(l1: DataFrame, events: dict[str, DataFrame], p: Params) -> DataFrame:
    """Energy, distance, duration and mean speed of events, keyed by (kind, recordingId, event_id).

    Several event tables, told apart by ``kind``, share one pass over the frames. Frames of unknown
    length count nothing. An event with its own duration keeps it, otherwise the time span of its
    frames is taken. Events without frames are absent.
    """
    spans = reduce(DataFrame.unionByName, [_spans(table, kind) for kind, table in events.items()])
    place = "s_long" if "s_long" in l1.columns else "s"
    rates = {"E_CO2": "cpf_co2_rate_gps", "E_fuel": "cpf_fuel_rate_lps"}
    timed = "dt" in l1.columns
    frames = l1 if timed else with_shifted(l1, {"_before": ("time", -1), "_after": ("time", 1)}, p)
    wanted = ["recordingId", "trackId", "frame", "time", place, "v_long_smooth", *rates.values()]
    wanted += ["dt", "frame_s"] if timed else ["_before", "_after"]
    rows = slice_frames(
        frames.select(*[c for c in wanted if c in frames.columns]), spans, F.col("_from"), F.col("_upto"), p)

    def used(rate: str) -> Column:
        if rate not in rows.columns:
            return F.lit(None).cast("double")
        amount = F.col(rate).cast("double")
        if timed:
            seconds = F.when(F.col("dt").isNotNull(), frame_seconds(rows.columns, p.frame_rate))
            return F.coalesce(F.sum(amount * seconds), F.lit(0.0))
        # A frame lasts as long as the step from the frame before; the first one as long as the second.
        step = F.coalesce(amount * (F.col("time") - F.col("_before")), F.lit(0.0))
        first = F.coalesce(amount * (F.col("_after") - F.col("time")), F.lit(0.0))
        return F.sum(step) - F.min_by(step, "frame") + F.when(F.count("*") > 1, F.min_by(first, "frame")).otherwise(0.0)

    span = F.max("time") - F.min("time") if "time" in rows.columns else (F.max("frame") - F.min("frame")) * 0.04
    travelled = F.max_by(place, "frame") - F.min_by(place, "frame")
    return rows.groupBy(KIND, "recordingId", "event_id").agg(
        *[used(rate).alias(name) for name, rate in rates.items()],
        F.when(F.count("*") > 1, travelled).alias("dist_m"),
        F.coalesce(F.max("_own_duration"), span).alias("duration"),
        F.avg(F.col("v_long_smooth").cast("double")).alias("mean_v"),
    )


def _with_metrics(events: DataFrame, metrics: DataFrame, kind: str) -> DataFrame:
    own = metrics.filter(F.col(KIND) == kind).drop(KIND).withColumnRenamed("duration", "_metric_duration")
    joined = events.join(own, ["recordingId", "event_id"], "left")
    given = F.col("duration") if "duration" in events.columns else F.lit(None)
    return joined.withColumn("_metric_duration", F.coalesce("_metric_duration", given))


def match_baselines(l1: DataFrame, conflicts: DataFrame, baselines: DataFrame, p: Params) -> DataFrame:
    """One row per conflict with its baseline's figures; unmatched conflicts keep empty ones."""
    metrics = materialize(episode_metrics(l1, {"conflict": conflicts, "baseline": baselines}, p), "metrics")
    conf = _with_metrics(conflicts, metrics, "conflict")
    base = _with_metrics(baselines, metrics, "baseline")
    flow = F.col("flow_state") if "flow_state" in conflicts.columns else F.lit("unknown")
    probes = conf.select(
        "recordingId", "veh_class", F.col("event_id").alias("l2_event_id"), "ego_id", flow.alias("flow_state"),
        "min_TTC_conf", "conf_duration", F.col("_metric_duration").alias("duration"),
        F.col("dist_m").alias("dist_real_m"), F.col("E_CO2").alias("E_real_CO2"),
        F.col("E_fuel").alias("E_real_fuel"), F.col("mean_v").alias("mean_v_conf"),
        *[c for c in CARRIED if c in conflicts.columns],
    )
    candidates = base.select(
        "recordingId", "veh_class", F.col("event_id").alias("base_id"),
        F.col("_metric_duration").alias("cand_duration"), F.col("mean_v").alias("cand_speed"))
    chosen = nearest_by_speed(
        probes.select("recordingId", "veh_class", "l2_event_id", F.col("duration").alias("probe_duration"),
                      F.col("mean_v_conf").alias("probe_speed")),
        candidates, p)
    partner = base.select(
        "recordingId", F.col("event_id").alias("base_id"),
        F.col("_metric_duration").alias("duration_base"), F.col("dist_m").alias("dist_base_m"),
        F.col("E_CO2").alias("E_base_CO2"), F.col("E_fuel").alias("E_base_fuel"),
        F.col("mean_v").alias("mean_v_base"),
        *[F.col(c).alias(f"base_{c}") for c in baselines.columns],
    )
    matched = (
        probes.join(chosen, ["recordingId", "l2_event_id"], "left")
        .join(partner, ["recordingId", "base_id"], "left")
    )
    return _costs(matched, [f"base_{c}" for c in baselines.columns])


def _costs(matched: DataFrame, base_columns: list[str]) -> DataFrame:
    rated = matched.withColumns({
        "E_real_CO2_per_km": per_km(F.col("E_real_CO2"), F.col("dist_real_m")),
        "E_base_CO2_per_km": per_km(F.col("E_base_CO2"), F.col("dist_base_m")),
        "E_real_CO2_per_s": per_second(F.col("E_real_CO2"), F.col("duration")),
        "E_base_CO2_per_s": per_second(F.col("E_base_CO2"), F.col("duration_base")),
        "MEC_CO2_per_event": F.col("E_real_CO2") - F.col("E_base_CO2"),
        "MEC_bucket": ttc_bucket(F.col("min_TTC_conf")),
        "event_id": F.col("l2_event_id") - 1,
        "rec_id": F.col("recordingId"),
    }).withColumn("MEC_CO2_per_km", F.col("E_real_CO2_per_km") - F.col("E_base_CO2_per_km"))
    carried = [c for c in CARRIED if c in matched.columns]
    return rated.select(
        "rec_id", "event_id", "ego_id", "veh_class", "flow_state", "min_TTC_conf", "conf_duration", "duration",
        "duration_base", "dist_real_m", "dist_base_m", "E_real_CO2", "E_real_fuel", "E_base_CO2", "E_base_fuel",
        "mean_v_conf", "mean_v_base", "E_real_CO2_per_km", "E_base_CO2_per_km", "E_real_CO2_per_s",
        "E_base_CO2_per_s", "MEC_CO2_per_km", "MEC_CO2_per_event", "MEC_bucket", *base_columns,
        "l2_event_id", *carried,
    )
