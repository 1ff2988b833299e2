"""Sensitivity of conflict detection to its thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kerbline.operators.quantiles import summarise
from kerbline.operators.store import materialize
from kerbline.params import Params
from kerbline.plans.events import THRESHOLD, conflict_windows

# The thresholds compared.
TTC_LEVELS = (2.0, 3.0, 4.0)
DURATION_LEVELS = (0.4, 0.6, 0.8, 1.0)


def threshold_sweep(l1: DataFrame, p: Params, ttc_levels: Sequence[float] = TTC_LEVELS,
                    duration_levels: Sequence[float] = DURATION_LEVELS) -> DataFrame:
    """Conflict count and medians for every pair of thresholds, from one pass over the frames."""
    levels = [float(d) for d in duration_levels]
    events = materialize(
        conflict_windows(l1, p, ttc_levels, min(levels)).select(
            F.col(THRESHOLD).alias("TTC_thr"), "conf_duration", "min_TTC_conf", "E_cpf_CO2"), "sweep")
    every = F.array(*[F.lit(d) for d in levels])
    reached = F.filter(every, lambda d: F.col("conf_duration") >= d * (1 - 1e-6))
    cells = summarise(
        events.withColumn("dur_thr", F.explode(reached)), ["TTC_thr", "dur_thr"], [F.count("*").alias("n_conf")],
        [("min_TTC_conf", 0.5, "med_min_TTC_conf"), ("conf_duration", 0.5, "med_conf_dur"),
         ("E_cpf_CO2", 0.5, "med_E_CO2")])
    grid = l1.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(float(t)) for t in ttc_levels])).alias("TTC_thr"), every.alias("_d"),
    ).select("TTC_thr", F.explode("_d").alias("dur_thr"))
    return grid.join(cells, ["TTC_thr", "dur_thr"], "left").fillna({"n_conf": 0}).orderBy("TTC_thr", "dur_thr")
